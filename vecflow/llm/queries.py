"""The registered queries of this subpackage: each applies one operator, with the
parameters below, to its whole table and derives the contract's columns.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecflow.llm import (bpe, clustering, embedding_dedup, fingerprint, language_model, mixing, ngram_join, packing, quality,
                         suffix_dedup, toxicity, warc, whitening)
from vecflow.llm.common import prepare, table
from vecflow.session import scratch_dir


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file, from the installed package that lists them."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.link_documents(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    read = warc.archive_pages(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return clustering.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_ngram_join": op2_ngram_join,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_maxent_scores": op5_maxent_scores,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_mix": op11_source_mix,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op3_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT payload_digest, max(page_id) AS kept FROM d GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM d JOIN k USING (payload_digest)""",
    "op11_source_mix": mixing.MIX_SQL,
    "op12_centroid_clusters": clustering.cluster_sql(),
}
