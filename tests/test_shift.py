import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecflow.operators import SHIFT, scale, shift, vector_scale, vector_shift


def test_shift_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    r = shift(df).first()
    assert (r.x, r.y, r.z) == (1.0 + 25.25, 2.0 - 12.125, 3.0 + 6.333)
    assert SHIFT == (25.25, -12.125, 6.333)


def test_shift_width_mismatch(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    with pytest.raises(ValueError):
        shift(df, (1.0, 2.0))


def test_vector_shift_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "v array<double>")
    out = [r.v for r in vector_shift(df, [1.0, 1.0, 1.0, 1.0]).collect()]
    assert [1.0 + 1, 2.0 + 1, 3.0 + 1, 4.0 + 1] in out and None in out
    wide = [0.5] * 200  # higher-order path
    df2 = spark.createDataFrame([([1.0] * 200,)], "v array<double>")
    assert vector_shift(df2, wide).first().v == [1.5] * 200


def test_vector_shift_width_mismatch_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(PySparkException):
        vector_shift(df, [1.0, 1.0, 1.0]).collect()


def test_scale(spark):
    df = spark.createDataFrame([(2.0, 4.0, 8.0, 2)], "x double, y double, z double, n int")
    r = scale(df, 2).first()
    assert (r.x, r.y, r.z) == (1.0, 2.0, 4.0)
    r = scale(df, "n").first()
    assert (r.x, r.y, r.z) == (1.0, 2.0, 4.0)
    a = spark.createDataFrame([([2.0, 4.0],)], "v array<double>")
    assert vector_scale(a, 2.0).first().v == [1.0, 2.0]
    assert vector_scale(a, F.lit(4.0), width=2).first().v == [0.5, 1.0]
