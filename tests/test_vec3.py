import os

import numpy as np
import pytest

from vecflow.sinks.vectors import write_vec3
from vecflow.sources.load import load_vectors, read_vec3


def _write(path, doubles, extra=b""):
    with open(path, "wb") as f:
        f.write(np.asarray(doubles, dtype=">f8").tobytes() + extra)


def _data_files(folder):
    """Files of planes that a finished job has left."""
    return [os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if d.endswith("kind=xyz") and not n.startswith((".", "_"))]


@pytest.fixture
def files(tmp_dir):
    d = os.path.join(tmp_dir, "vec")
    os.makedirs(d)
    _write(os.path.join(d, "a.bin"), np.arange(3000))
    _write(os.path.join(d, "b.bin"), np.arange(7), extra=b"\x01\x02\x03")
    _write(os.path.join(d, "c.bin"), [])
    open(os.path.join(d, "_SUCCESS"), "w").close()
    return d


def test_planar_big_endian_decode(spark, files):
    df = read_vec3(spark, files)
    rows = df.orderBy("block_id", "row_id").collect()
    a = [r for r in rows if r.path.endswith("a.bin")]
    b = [r for r in rows if r.path.endswith("b.bin")]
    assert len(a) == 1000 and len(b) == 2 and len(rows) == 1002  # empty file: no rows
    assert (a[0].x, a[0].y, a[0].z) == (0.0, 1000.0, 2000.0)
    assert (a[999].x, a[999].y, a[999].z) == (999.0, 1999.0, 2999.0)
    assert [(r.x, r.y, r.z) for r in b] == [(0.0, 2.0, 4.0), (1.0, 3.0, 5.0)]
    assert {r.block_id for r in a} == {0} and {r.block_id for r in b} == {1}
    assert {r.matrix_id for r in rows} == {0}


def test_splits_and_pruned_planes(spark, files):
    df = spark.read.format("vec3").schema("x double, row_id bigint").option("rowsPerSplit", 128) \
        .option("batchRows", 50).load(files)
    assert df.rdd.getNumPartitions() == 8 + 1  # a.bin: 1000 rows in splits of 128; b.bin: one split
    got = sorted((r.row_id, r.x) for r in df.collect())
    assert len(got) == 1002 and got[-1] == (999, 999.0)


def test_roundtrip_writer(spark, tmp_dir):
    src = spark.range(0, 5000, 1, 4).selectExpr("cast(id as double) x", "id * 2.0 y", "-id * 1.0 z")
    out = os.path.join(tmp_dir, "out")
    write_vec3(src, out)
    assert len(_data_files(out)) == 4
    back = read_vec3(spark, out)
    assert sorted((r.x, r.y, r.z) for r in back.collect()) == sorted((r.x, r.y, r.z) for r in src.collect())
    # overwrite replaces the earlier files
    write_vec3(src.limit(10), out)
    assert read_vec3(spark, out).count() == 10


def test_load_vectors_choice(spark, files):
    gen = load_vectors(spark, generate=True, src=files, blocks=0, block_size=1, multiplier=3)
    assert gen.count() == 3  # generate wins over src
    assert load_vectors(spark, src=files).count() == 1002
    with pytest.raises(ValueError):
        load_vectors(spark)


def test_filters_leave_later_queries_alone(spark, files):
    df = read_vec3(spark, files)
    assert sorted((r.x, r.y, r.z) for r in df.filter("block_id = 1").collect()) == [(0.0, 2.0, 4.0), (1.0, 3.0, 5.0)]
    rng = df.filter("block_id in (0) and row_id >= 10 and row_id < 20")
    assert sorted(r.row_id for r in rng.collect()) == list(range(10, 20))
    assert df.filter("x > 997").count() == 2
    assert df.filter("block_id > 0 or row_id = 5").count() == 3
    assert df.count() == 1002  # what earlier queries asked for is not kept


def test_blocks_option_prunes_files(spark, files):
    only_b = read_vec3(spark, files, blocks="1")
    assert only_b.rdd.getNumPartitions() == 1 and only_b.count() == 2
    assert read_vec3(spark, files, blocks="0,1").count() == 1002 and read_vec3(spark, files, blocks="").count() == 0


def test_writer_splits_large_partitions(spark, tmp_dir):
    src = spark.range(0, 1000, 1, 1).selectExpr("cast(id as double) x", "0.0 y", "1.0 z")
    out = os.path.join(tmp_dir, "split")
    write_vec3(src, out, max_rows=300)
    bins = _data_files(out)
    assert len(bins) == 4
    sizes = sorted(os.path.getsize(n) // 24 for n in bins)
    assert sizes == [100, 300, 300, 300]
    assert sorted(r.x for r in read_vec3(spark, out).collect()) == [float(i) for i in range(1000)]


def test_empty_folder(spark, tmp_dir):
    d = os.path.join(tmp_dir, "none")
    os.makedirs(d)
    assert read_vec3(spark, d).count() == 0


def _blocks(spark, rows=900, parts=3):
    """Blocks and matrices interleaved over all partitions; row ids that are no positions."""
    return spark.range(0, rows, 1, parts).selectExpr("id % 4 block_id", "cast(id % 3 as int) matrix_id", "id * 10 row_id",
                                                     "cast(id as double) x", "cast(id * 2 as double) y", "cast(-id as double) z")


@pytest.mark.parametrize("parts,cap", [(1, 4096), (5, 4096), (3, 7)])
def test_blocks_survive_whatever_the_files(spark, tmp_dir, parts, cap):
    from vecflow import operators as ops

    src = _blocks(spark, parts=parts)
    out = os.path.join(tmp_dir, f"blocks-{parts}-{cap}")
    write_vec3(src, out, max_rows=cap)
    back = read_vec3(spark, out, columns=("block_id", "matrix_id", "row_id", "x", "y", "z"))
    assert sorted(back.collect()) == sorted(src.collect())
    assert back.filter("block_id = 2 and row_id < 300").count() == src.filter("block_id = 2 and row_id < 300").count() > 0
    one, two = (ops.reduce_block_means(ops.block_means(d)).first() for d in (src, back))
    assert tuple(one) == pytest.approx(tuple(two))


def test_append_and_overwrite(spark, tmp_dir):
    out = os.path.join(tmp_dir, "m")
    write_vec3(_blocks(spark, 100), out)
    write_vec3(_blocks(spark, 60), out, mode="append")
    assert read_vec3(spark, out).count() == 160
    # a file of a job that never committed
    left = os.path.join(out, "_temporary/0/block_id=0/matrix_id=0/chunk=c/kind=xyz")
    os.makedirs(left)
    _write(os.path.join(left, "_part-0"), np.arange(30))
    assert read_vec3(spark, out).count() == 160
    write_vec3(_blocks(spark, 20), out)
    assert read_vec3(spark, out).count() == 20 and not os.path.exists(left)


@pytest.mark.parametrize("column", ["x", "block_id", "row_id"])
def test_null_cannot_be_written(spark, tmp_dir, column):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    bad = _blocks(spark, 10).withColumn(column, F.expr(f"if(row_id = 50, null, {column})"))
    with pytest.raises(PySparkException, match="NULL"):
        write_vec3(bad, os.path.join(tmp_dir, "bad"))
    assert not _data_files(os.path.join(tmp_dir, "bad"))


def test_scan_prunes_by_predicate_and_keeps_nothing(spark, tmp_dir):
    from vecflow.sources.load import scan_vec3

    src = _blocks(spark, 900)
    out = os.path.join(tmp_dir, "scan")
    write_vec3(src, out, max_rows=50)
    df = scan_vec3(spark, out)
    assert sorted(df.collect()) == sorted(src.collect())
    some = scan_vec3(spark, out, "block_id = 2 and matrix_id in (0, 1)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(some.collect()) == sorted(src.filter("block_id = 2 and matrix_id < 2").collect())
    # two queries on one DataFrame
    assert df.filter("block_id = 1").count() == 225 and df.filter("block_id = 3").count() == 225 and df.count() == 900
    assert scan_vec3(spark, out, columns=("x",)).columns == ["x"]


def test_hot_matrix_is_cut(spark, tmp_dir):
    src = _blocks(spark, 600).selectExpr("0L block_id", "if(row_id < 4000, 0, matrix_id) matrix_id", "row_id", "x", "y", "z")
    out = os.path.join(tmp_dir, "hot")
    write_vec3(src, out, max_rows=100)
    assert sorted(read_vec3(spark, out, columns=("block_id", "matrix_id", "row_id", "x", "y", "z")).collect()) == sorted(src.collect())
    assert max(os.path.getsize(f) // 24 for f in _data_files(out)) <= 100
