import math
import os

from vecflow.plans.pipeline import run_pipeline
from vecflow.sources.reports import read_reports


def test_eager_equals_lazy_and_counts(spark, tmp_dir):
    kw = dict(generate=True, blocks=2, block_size=3, multiplier=200, nodes=1, cores=2, nparts=2)
    eager = run_pipeline(spark, **kw)
    lazy = run_pipeline(spark, lazy=True, **kw)
    for k in eager.result:
        assert math.isclose(eager.result[k], lazy.result[k], rel_tol=1e-12)
    assert eager.counts == {"generate": 1800, "shift": 1800, "average": 3}
    assert lazy.counts == eager.counts
    assert math.isclose(eager.timings["overall"], sum(eager.timings[p] for p in ("map", "shift", "average", "reduce")))
    # sum of 3 block means of coordinates uniform in [-1000, 1000) shifted: near 3 * shift
    assert abs(eager.result["sum_of_block_means_x"] - 3 * 25.25) < 60


def test_hybrid_and_reports(spark, tmp_dir):
    jd, xd, dst = (os.path.join(tmp_dir, n) for n in ("json", "xml", "dst"))
    run = run_pipeline(spark, generate=True, blocks=1, block_size=2, multiplier=100, hybrid=True,
                       job_id="job1", json_dir=jd, xml_dir=xd, dst=dst, checkpoint=True)
    assert os.listdir(jd) == ["job1.json"] and os.listdir(xd) == ["job1.xml"]
    assert os.path.isdir(os.path.join(dst, "results"))
    for fmt, d in (("json", jd), ("xml", xd)):
        r = read_reports(spark, d, fmt).first()
        assert r.job_id == "job1" and r.generate == 1 and r.blocks == 1 and r.block_size == 2
        assert r.map_time == round(run.timings["map"] * 1e9)
    assert run.report.first().hybrid == 1


def test_disk_only_and_extra_columns(spark):
    from pyspark import StorageLevel
    from pyspark.sql import functions as F

    from vecflow.sources.generate import generate_vectors

    v = generate_vectors(spark, blocks=1, block_size=2, multiplier=50, num_partitions=3).withColumn(
        "payload", F.repeat(F.lit("x"), 100))
    a = run_pipeline(spark, v, storage_level=StorageLevel.DISK_ONLY)
    b = run_pipeline(spark, v, lazy=True)
    assert a.counts == b.counts == {"generate": 200, "shift": 200, "average": 2}
    for k in a.result:
        assert math.isclose(a.result[k], b.result[k], rel_tol=1e-12)


def test_dst_keeps_every_column_and_reads_the_source_once(spark, tmp_dir):
    from pyspark.sql import functions as F

    from vecflow.sources.generate import generate_vectors

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    v = generate_vectors(spark, blocks=1, block_size=2, multiplier=50, num_partitions=3).withColumn("x", counted("x"))
    dst = os.path.join(tmp_dir, "dst")
    run = run_pipeline(spark, v, dst=dst)
    out = spark.read.parquet(os.path.join(dst, "results"))
    assert out.columns == ["block_id", "matrix_id", "row_id", "x", "y", "z"] and out.count() == 200
    assert out.select("row_id").distinct().count() == 50 and seen.value == 200
    r = run.report.first()
    assert (r.blocks, r.block_size, r.generate, r.nodes) == (None, None, None, None)  # not known of a given DataFrame


def test_checkpointed_phases_are_computed_once(spark):
    from pyspark.sql import functions as F

    from vecflow.sources.generate import generate_vectors

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    v = generate_vectors(spark, blocks=0, block_size=2, multiplier=50, num_partitions=2).withColumn("x", counted("x"))
    run_pipeline(spark, v, checkpoint=True)
    assert seen.value == 100


def test_stores_agree_and_release_their_phases(spark):
    import pytest

    from vecflow import session

    kw = dict(generate=True, blocks=2, block_size=2, multiplier=300, nodes=1, cores=2, nparts=2)
    before = list(session._SCRATCH)
    found = {s: run_pipeline(spark, store=s, **kw) for s in ("files", "memory", "checkpoint")}
    for run in found.values():
        assert run.counts == {"generate": 1800, "shift": 1800, "average": 3}
        assert run.block_means.count() == 3
        for k, v in found["files"].result.items():
            assert math.isclose(run.result[k], v, rel_tol=1e-12)
    assert len(session._SCRATCH) == len(before) + 1  # only the block means of the file store are left
    with pytest.raises(ValueError):
        run_pipeline(spark, store="tape", **kw)
