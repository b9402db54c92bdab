import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecflow import operators as ops
from vecflow.sources.generate import generate_vectors


def _unequal(spark):
    # block 0: matrix 0 has 1 row, matrix 1 has 3 rows -> mean of means != row mean
    rows = [(0, 0, 0, 10.0, 0.0, 1.0),
            (0, 1, 0, 1.0, 2.0, 3.0), (0, 1, 1, 2.0, 2.0, 3.0), (0, 1, 2, 3.0, 2.0, 3.0),
            (1, 0, 0, 4.0, 4.0, 4.0)]
    return spark.createDataFrame(rows, "block_id long, matrix_id int, row_id long, x double, y double, z double")


def test_matrix_means_and_sums(spark):
    df = _unequal(spark)
    m = {(r.block_id, r.matrix_id): r for r in ops.matrix_means(df).collect()}
    assert m[(0, 1)].n == 3 and m[(0, 1)].x == 2.0
    s = {(r.block_id, r.matrix_id): r for r in ops.matrix_sums(df).collect()}
    assert s[(0, 1)].x == 6.0 and s[(0, 0)].x == 10.0


def test_block_mean_is_unweighted_mean_of_matrix_means(spark):
    df = _unequal(spark)
    b = {r.block_id: r for r in ops.block_means(df).collect()}
    assert b[0].x == (10.0 + 2.0) / 2  # 6.0, while the row mean is 16/4 = 4.0
    assert b[0].n_matrices == 2
    row_mean = df.filter("block_id = 0").agg(F.avg("x")).first()[0]
    assert row_mean == 4.0 != b[0].x


def test_hybrid_equals_functional(spark):
    df = generate_vectors(spark, blocks=3, block_size=4, multiplier=1000, num_partitions=5)
    f = {r.block_id: r for r in ops.block_means(df, "functional").collect()}
    h = {r.block_id: r for r in ops.block_means(df, "hybrid").collect()}
    assert f.keys() == h.keys()
    for k in f:
        assert f[k].n_matrices == h[k].n_matrices
        for c in "xyz":
            assert math.isclose(f[k][c], h[k][c], rel_tol=1e-12, abs_tol=1e-9)


def test_choose_method_precedence():
    assert ops.choose_method(functional=True, hybrid=True) == "functional"
    assert ops.choose_method(hybrid=True, imperative=True) == "hybrid"
    assert ops.choose_method(imperative=True) == "functional"
    assert ops.choose_method() == "functional"


def test_reduce_is_sum_of_block_means(spark):
    df = _unequal(spark)
    bm = ops.block_means(df)
    r = ops.reduce_block_means(bm).first()
    assert r.sum_of_block_means_x == 6.0 + 4.0
    assert set(r.asDict()) == {"sum_of_block_means_x", "sum_of_block_means_y", "sum_of_block_means_z"}


def test_global_means(spark):
    df = _unequal(spark)
    w = ops.global_mean(df, weighted=True).first()
    u = ops.global_mean(df, weighted=False).first()
    assert w.mean_x == 20.0 / 5
    assert u.mean_x == (6.0 + 4.0) / 2


def test_mean_of_shift_is_shifted_mean(spark):
    df = generate_vectors(spark, blocks=1, block_size=2, multiplier=300, num_partitions=3)
    before = ops.global_mean(df).first()
    after = ops.global_mean(ops.shift(df)).first()
    for c, d in zip("xyz", ops.SHIFT):
        assert math.isclose(after[f"mean_{c}"], before[f"mean_{c}"] + d, abs_tol=1e-9)


def test_shift_twice_on_persisted_input(spark):
    # the reference mutated cached blocks in place; here a re-run gives the same answer
    df = generate_vectors(spark, blocks=0, block_size=2, multiplier=50, num_partitions=2).persist()
    a = sorted(ops.shift(df).collect())
    b = sorted(ops.shift(df).collect())
    assert a == b
    df.unpersist()


def test_scale_by_matrix_rows_sums_to_matrix_mean(spark):
    df = _unequal(spark)
    scaled = ops.scale_by_matrix_rows(df)
    per = {(r.block_id, r.matrix_id): r.sx for r in scaled.groupBy("block_id", "matrix_id").agg(
        F.sum("x").alias("sx")).collect()}
    means = {(r.block_id, r.matrix_id): r.x for r in ops.matrix_means(df).collect()}
    for k in means:
        assert math.isclose(per[k], means[k])


def test_vector_sum_nd(spark):
    rows = [(i % 3, [float(i), float(2 * i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    a = sorted(tuple(r) for r in ops.vector_sum_nd(df, "v", ["k"]).collect())
    assert len(a) == 9
    assert (0, 0, float(sum(range(0, 30, 3)))) in a and (0, 2, 10.0) in a


def test_scale_by_matrix_rows_split_path(spark):
    # one hot matrix (a third of the rows and more) plus many light ones
    hot = [(0, 0, i, float(i), 1.0, 2.0) for i in range(400)]
    light = [(1 + i % 7, i % 11, i, float(i), 3.0, 4.0) for i in range(800)]
    df = spark.createDataFrame(hot + light, "block_id long, matrix_id int, row_id long, x double, y double, z double")
    a = sorted(ops.scale_by_matrix_rows(df).collect())
    b = sorted(ops.scale_by_matrix_rows(df, max_broadcast_rows=1).collect())  # bound exceeded: split join
    assert a == b and len(b) == 1200
    assert {r.y for r in b if r.block_id == 0} == {1.0 / 400}


def test_phase_counts(spark):
    df = generate_vectors(spark, blocks=2, block_size=2, multiplier=10, num_partitions=3)
    r = ops.phase_counts(df, ops.shift(df)).first()
    assert (r.generate_rows, r.shift_rows, r.average_rows) == (60, 60, 3)


def test_hybrid_skips_nulls_like_avg(spark):
    rows = [(0, 0, 0, 1.0, None, 5.0), (0, 0, 1, None, None, 7.0), (0, 1, 0, 3.0, 2.0, None),
            (1, 0, 0, None, None, None)]
    df = spark.createDataFrame(rows, "block_id long, matrix_id int, row_id long, x double, y double, z double")
    f = sorted(tuple(r) for r in ops.matrix_means(df).collect())
    h = sorted(tuple(r) for r in ops.matrix_means_hybrid(df).collect())
    assert f == h
    assert sorted(tuple(r) for r in ops.block_means(df, "hybrid").collect()) == \
        sorted(tuple(r) for r in ops.block_means(df).collect())


def test_null_keys_are_scaled_too(spark):
    rows = [(None if i % 10 == 0 else i % 3, i % 2, i, 1.0, 2.0, 3.0) for i in range(100)]
    df = spark.createDataFrame(rows, "block_id long, matrix_id int, row_id long, x double, y double, z double")
    for bound in (10_000, 0):  # broadcast, and hot keys apart
        out = ops.scale_by_matrix_rows(df, max_broadcast_rows=bound)
        assert out.count() == 100
        assert out.agg(F.sum("x")).first()[0] == pytest.approx(df.select("block_id", "matrix_id").distinct().count())


def test_phases_are_counted_each_on_its_own(spark):
    df = generate_vectors(spark, blocks=1, block_size=2, multiplier=25, num_partitions=2)
    r = ops.phase_counts(df, ops.shift(df).filter("row_id < 5 and block_id = 0")).first()
    assert (r.generate_rows, r.shift_rows, r.average_rows) == (100, 10, 1)


def test_ragged_vectors_do_not_add(spark):
    ragged = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [1.0]), (2, None), (3, [5.0])], "k int, v array<double>")
    with pytest.raises(PySparkException, match="different widths"):
        ops.vector_sum_nd(ragged, "v", ["k"]).collect()
    assert [tuple(r) for r in ops.vector_sum_nd(ragged.filter("k > 1"), "v", ["k"]).collect()] == [(3, 0, 5.0)]


@pytest.mark.parametrize("width", [3, 5, 128, 129])
def test_array_scale_keeps_or_refuses(spark, width):
    df = spark.createDataFrame([([2.0, 4.0, 6.0, 8.0],), (None,)], "v array<double>")
    assert [r.v for r in ops.vector_scale(df, 2.0).collect()] == [[1.0, 2.0, 3.0, 4.0], None]
    assert [r.v for r in ops.vector_scale(df, 2.0, width=4).collect()] == [[1.0, 2.0, 3.0, 4.0], None]
    with pytest.raises(PySparkException, match="width"):
        ops.vector_scale(df, 2.0, width=width).collect()
