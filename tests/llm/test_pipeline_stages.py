"""The pipeline's stages, each against its operator's brute-force version over its own input."""

import corpus_pipeline
from helpers import cut_repeats, jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        seen[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "ngram_join", "suffix_dedup", "packing"]
    for name in ("quality", "toxicity"):
        before, after = seen[name]
        assert set(after) < set(before)
    before, after = seen["ngram_join"]
    component = jaccard_components([(r.doc_id, r.text) for r in before])
    assert set(after) == {r for r in before if component[r.doc_id][1] == r.doc_id} and len(after) < len(before)
    before, after = seen["suffix_dedup"]
    want = {r.doc_id: w[0].decode(errors="ignore") for r, w in zip(before, cut_repeats([r.text for r in before], 400))}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048 and corpus_pipeline.ORACLE_SQL is None
