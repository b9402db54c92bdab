"""Property-based checks (the reference left these as a TODO)."""

import os
import uuid

import numpy as np
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecflow.functions.ids import dense_index
from vecflow.functions.random import uniform_double
from vecflow.sources.load import read_vec3

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(n=st.integers(0, 400), stray=st.integers(0, 7), split=st.integers(1, 50))
def test_vec3_decodes_any_length(spark, tmp_path, n, stray, split):
    d = os.path.join(str(tmp_path), uuid.uuid4().hex)
    os.makedirs(d)
    values = np.random.default_rng(n).normal(size=n)
    with open(os.path.join(d, "f.bin"), "wb") as f:
        f.write(values.astype(">f8").tobytes() + b"\x00" * stray)
    rows = n // 3
    got = sorted((r.row_id, r.x, r.y, r.z) for r in read_vec3(spark, d, rowsPerSplit=split).collect())
    want = [(i, values[i], values[rows + i], values[2 * rows + i]) for i in range(rows)]
    assert got == want


@SLOW
@given(n=st.integers(0, 3000), parts=st.integers(1, 17), mod=st.integers(1, 50))
def test_dense_index_is_a_permutation_in_order(spark, n, parts, mod):
    df = spark.range(0, n, 1, parts).select((F.col("id") % mod).alias("k"), F.col("id").alias("v"))
    rows = sorted((r.i, r.k, r.v) for r in dense_index(df, ["k", "v"], name="i").collect())
    assert [r[0] for r in rows] == list(range(n))
    assert [(k, v) for _, k, v in rows] == sorted((k, v) for _, k, v in rows)


@SLOW
@given(seed=st.integers(-(2**31), 2**31), low=st.floats(-1e6, 1e6), width=st.floats(1e-3, 1e6))
def test_uniform_double_in_range(spark, seed, low, width):
    high = low + width
    df = spark.range(0, 2000, 1, 3).select(uniform_double(seed, low, high, F.col("id")).alias("u"))
    lo, hi = df.agg(F.min("u"), F.max("u")).first()
    assert low <= lo and hi <= high


RUN = st.tuples(
    st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126),
            min_size=0, max_size=12),
    st.integers(0, 1), st.integers(1, 4096), st.integers(1, 64), st.integers(1, 256), st.integers(0, 10**6),
    st.integers(1, 10**6),
    st.floats(0, 1e15), st.floats(0, 1e15), st.floats(0, 1e15),
)


@SLOW
@given(rows=st.lists(RUN, min_size=1, max_size=6), fmt=st.sampled_from(["json", "xml"]),
       version=st.sampled_from([1, 2]), layout=st.sampled_from(["files", "records"]))
@example(rows=[(' a<b>&"c\' ', 1, 2, 3, 4, 5, 6, 1e-3, 7.5e14, 0.0)], fmt="xml", version=2, layout="files")
@example(rows=[(' a<b>&"c\' ', 1, 2, 3, 4, 5, 6, 1e-3, 7.5e14, 0.0)], fmt="json", version=1, layout="files")
@example(rows=[(' a<b>&"c\' ', 1, 2, 3, 4, 5, 6, 1e-3, 7.5e14, 0.0)], fmt="xml", version=1, layout="records")
@example(rows=[(' a<b>&"c\' ', 1, 2, 3, 4, 5, 6, 1e-3, 7.5e14, 0.0)], fmt="json", version=2, layout="records")
def test_report_files_roundtrip(spark, tmp_path, rows, fmt, version, layout):
    from vecflow.sinks.report_files import write_report_files
    from vecflow.sinks.reports import write_reports
    from vecflow.sources.reports import read_reports

    # v1 stores ns as written; v2 stores seconds and is read back as whole ns
    data = [(e, g, n, c, p, b, k, float(round(m)), float(round(s)), float(round(a)), f"j{i}")
            for i, (e, g, n, c, p, b, k, m, s, a) in enumerate(rows)]
    df = spark.createDataFrame(data, "experiment_id string, generate int, nodes int, cores int, nparts int, "
                                     "blocks int, block_size int, map_time double, shift_time double, "
                                     "avg_time double, job_id string")
    d = os.path.join(str(tmp_path), uuid.uuid4().hex)
    if layout == "files":
        write_report_files(df, d, fmt, version)
    else:
        write_reports(df, d, fmt, version)
    cols = ["experiment_id", "generate", "nodes", "cores", "nparts", "blocks", "block_size", "job_id"]
    back = read_reports(spark, d, fmt, layout)
    got = sorted(tuple(r) for r in back.select(*cols, "map_time", "shift_time", "avg_time").collect())
    want = sorted(tuple(r) for r in df.select(*cols, "map_time", "shift_time", "avg_time").collect())
    assert got == want


@SLOW
@given(hot=st.integers(0, 600), light=st.integers(0, 400), keys=st.integers(1, 30), bound=st.integers(1, 40))
def test_split_join_equals_broadcast_join(spark, hot, light, keys, bound):
    from vecflow.operators.joins import join_key_counts

    rows = [(0, i) for i in range(hot)] + [(1 + i % keys, i) for i in range(light)]
    if not rows:
        return
    big = spark.createDataFrame(rows, "k long, v long")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    a = sorted(tuple(r) for r in join_key_counts(big, counts, ["k"], "n").collect())
    b = sorted(tuple(r) for r in join_key_counts(big, counts, ["k"], "n", max_broadcast_rows=bound).collect())
    assert a == b and len(a) == len(rows)


@SLOW
@given(values=st.lists(st.tuples(st.floats(allow_nan=True, allow_infinity=True, width=64),
                                 st.floats(allow_nan=True, allow_infinity=True, width=64),
                                 st.floats(allow_nan=True, allow_infinity=True, width=64)), min_size=0, max_size=300),
       parts=st.integers(1, 4))
def test_vec3_write_read_preserves_bits(spark, tmp_path, values, parts):
    import struct

    from vecflow.sinks.vectors import write_vec3

    def bits(v):
        return struct.pack(">d", v)

    df = spark.createDataFrame(values, "x double, y double, z double").repartition(parts)
    d = os.path.join(str(tmp_path), uuid.uuid4().hex)
    write_vec3(df, d)
    back = read_vec3(spark, d, columns=("x", "y", "z")).collect()
    got = sorted(tuple(bits(v) for v in (r.x, r.y, r.z)) for r in back)
    want = sorted(tuple(bits(v) for v in row) for row in values)
    assert got == want
