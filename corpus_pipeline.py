"""Training-data pipeline: documents to packed sequences, in five stages.

Each stage is one of the operators of ``vecflow.llm`` over all that the stage before it
kept; its result is written as Parquet and read again as the next one's documents. All
but the last return the columns of ``documents``.

Defined cases, at every stage: an empty table gives no rows; extra columns pass through
all stages but the last; a null id is a value like any other; repeated rows are documents
each until the n-gram join keeps one of their group. Null and empty texts pass quality
(weight 0) and toxicity by their scores like others, are linked with nothing, stay null or
empty in suffix_dedup, and become one piece (the separator). Texts are read whole. ``n_chars``,
where there is one, follows the text (null for a null text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecflow.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from vecflow.llm.common import prepare, table
from vecflow.llm.queries import tokenizer_path
from vecflow.session import scratch_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the text labelled good; documents that it does not draw go."""
    prepare(spark)
    _, model = quality.resample(docs, table(spark, sf_dir, "labels"))
    return quality.keep_documents(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is 0.5 or more go."""
    prepare(spark)
    return toxicity.keep_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at 0.75, the document with the smallest id stays."""
    prepare(spark)
    return ngram_join.deduplicated(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated 400-byte strings go; rows stay, n_chars follows the text."""
    prepare(spark)
    kept = suffix_dedup.deduplicated(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: the stages learn models and cut texts by suffix arrays: not SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
