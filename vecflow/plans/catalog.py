"""
the driver's tables, with the equivalent DuckDB SQL as its oracle.

Adapters (same definition on both sides):

* ``v``    -- ``lineitem`` as vectors: block = ``l_suppkey % 8``, matrix =
  ``l_linenumber`` (matrices of unequal size on purpose), row = ``l_orderkey``,
  (x, y, z) = (quantity, extendedprice, discount).
* ``runs`` -- ``events`` as run records shaped like the ``results`` table.

Floating aggregates are rounded to 6 decimals on both sides (summation order
differs between engines in the last bit). Every query reads whole tables.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecflow import operators as ops
from vecflow.operators.joins import join_key_counts
from vecflow.plans import report_queries as rq
from vecflow.plans.pipeline import run_pipeline
from vecflow.plans.results_sql import results_view
from vecflow.session import ensure_checkpoint_dir, remove_scratch, scratch_dir, ship_package
from vecflow.sinks.export import export_file, export_text, read_text, with_position
from vecflow.sinks.report_files import PER_FOLDER, portions, remove_report_files, write_report_files
from vecflow.sinks.reports import write_reports
from vecflow.sinks.table import results_table, write_results_table
from vecflow.sinks.vectors import write_vec3, write_vectors
from vecflow.sources.generate import generate_vectors, uniform_draws
from vecflow.sources.load import read_vec3, scan_vec3
from vecflow.sources.reports import FLAT_COLUMNS, read_reports
from vecflow.sources import vec3

XYZ = ("x", "y", "z")
DIGITS = 6
# Displacement for the 64-wide vectors: element k is shifted by k/64 (a rule, not a table).
WIDE = 64
WIDE_SHIFT = tuple(k / WIDE for k in range(WIDE))
UNIFORM_SEED = 0


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    vec3.register(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- adapters
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("block_id"),
        F.col("l_linenumber").alias("matrix_id"),
        F.col("l_orderkey").alias("row_id"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_discount").alias("z"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    generated = (F.col("event_id") % 3) != 0
    return e.select(
        F.col("event_id").cast("int").alias("id"),
        F.col("event_type").alias("experiment_id"),
        F.when(generated, 1).otherwise(0).alias("generate"),
        F.pow(F.lit(2), F.col("user_id") % 7).cast("int").alias("nodes"),
        F.lit(12).alias("cores"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(4).alias("nparts"),
        (F.lit(16) * (F.lit(1) + F.col("event_id") % 5)).cast("int").alias("blocks"),
        (F.lit(64) * (F.lit(1) + F.col("user_id") % 4)).cast("int").alias("block_size"),
        F.round(F.col("value") * F.lit(1e9)).alias("map_time"),
        F.round(F.col("value") * F.lit(1.5e9)).alias("shift_time"),
        F.round(F.col("value") * F.lit(0.5e9)).alias("avg_time"),
        F.col("event_id").cast("string").alias("job_id"),
        F.when(generated, F.lit("")).otherwise(F.concat(F.lit("/data/vec3/"), F.col("user_id").cast("string")))
        .alias("src"),
        F.concat(F.lit("out/"), (F.col("user_id") % 16).cast("string")).alias("dst"),
    )


SQL_V = """v AS (SELECT l_suppkey % 8 AS block_id, l_linenumber AS matrix_id, l_orderkey AS row_id,
                 l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"""
SQL_SH = """sh AS (SELECT block_id, matrix_id, row_id, x + CAST(25.25 AS DOUBLE) AS x,
                  y + CAST(-12.125 AS DOUBLE) AS y, z + CAST(6.333 AS DOUBLE) AS z FROM v)"""
SQL_M = """m AS (SELECT block_id, matrix_id, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z
                 FROM sh GROUP BY block_id, matrix_id)"""
SQL_B = """b AS (SELECT block_id, count(*) AS n_matrices, avg(x) AS x, avg(y) AS y, avg(z) AS z
                 FROM m GROUP BY block_id)"""
SQL_RUNS = """runs AS (SELECT CAST(event_id AS INTEGER) AS id, event_type AS experiment_id,
         CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS generate,
         CAST(power(2, user_id % 7) AS INTEGER) AS nodes, 12 AS cores,
         CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS nparts,
         CAST(16 * (1 + event_id % 5) AS INTEGER) AS blocks,
         CAST(64 * (1 + user_id % 4) AS INTEGER) AS block_size,
         round(value * 1e9) AS map_time, round(value * 1.5e9) AS shift_time, round(value * 0.5e9) AS avg_time,
         CAST(event_id AS VARCHAR) AS job_id,
         CASE WHEN event_id % 3 <> 0 THEN '' ELSE '/data/vec3/' || CAST(user_id AS VARCHAR) END AS src,
         'out/' || CAST(user_id % 16 AS VARCHAR) AS dst
  FROM events)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(c: str) -> F.Column:
    return F.round(F.col(c), DIGITS).alias(c)


def _rounded(df: DataFrame, keys, cols) -> DataFrame:
    return df.select(*keys, *[_r(c) for c in cols])


# ---------------------------------------------------------------- vector queries
def q_shift_vectors(spark, sf_dir):
    """Every vector shifted by the fixed displacement."""
    return ops.shift(vectors(spark, sf_dir))


def q_matrix_sums(spark, sf_dir):
    """A1: column sums and row count per matrix."""
    return _rounded(ops.matrix_sums(vectors(spark, sf_dir)), ["block_id", "matrix_id", "n"], XYZ)


def q_matrix_means(spark, sf_dir):
    """A2: column means per matrix after the shift."""
    return _rounded(ops.matrix_means(ops.shift(vectors(spark, sf_dir))), ["block_id", "matrix_id", "n"], XYZ)


def q_block_means(spark, sf_dir):
    """A3 (A4 functional): block average = unweighted mean of matrix means."""
    return _rounded(ops.block_means(ops.shift(vectors(spark, sf_dir))), ["block_id", "n_matrices"], XYZ)


def q_block_means_hybrid(spark, sf_dir):
    """A4 hybrid: Arrow per-batch partial sums, native final aggregation."""
    _prepare(spark)
    bm = ops.block_means(ops.shift(vectors(spark, sf_dir)), method="hybrid")
    return _rounded(bm, ["block_id", "n_matrices"], XYZ)


def q_reduce_block_means(spark, sf_dir):
    """A5 (flagship, X3's answer): element-wise sum of block means."""
    red = ops.reduce_block_means(ops.block_means(ops.shift(vectors(spark, sf_dir))))
    return red.select(*[_r(c) for c in red.columns])


def q_global_mean(spark, sf_dir):
    """A6 weighted: mean over all rows."""
    g = ops.global_mean(ops.shift(vectors(spark, sf_dir)), weighted=True)
    return g.select(*[_r(c) for c in g.columns])


def q_mean_of_block_means(spark, sf_dir):
    """A6 unweighted: mean of the block means."""
    g = ops.global_mean(ops.shift(vectors(spark, sf_dir)), weighted=False)
    return g.select(*[_r(c) for c in g.columns])


def q_phase_counts(spark, sf_dir):
    """Elements after generate, shift and average."""
    v = vectors(spark, sf_dir)
    return ops.phase_counts(v, ops.shift(v))


def q_scale_vectors(spark, sf_dir):
    """Each vector divided by its matrix's row count (bounded broadcast join)."""
    return ops.scale_by_matrix_rows(vectors(spark, sf_dir))


def q_vector_shift_nd(spark, sf_dir):
    """64-wide row-broadcast add with width check."""
    emb = table(spark, sf_dir, "embeddings")
    return ops.vector_shift(emb, WIDE_SHIFT, array_col="embedding", out_col="v").select("vec_id", "label", "v")


def q_vector_sum_nd(spark, sf_dir):
    """Element-wise sums of 64-wide vectors per label."""
    emb = table(spark, sf_dir, "embeddings")
    s = ops.vector_sum_nd(emb, "embedding", ["label"])
    return s.select("label", "pos", _r("sum_v"))


def q_generate_structure(spark, sf_dir):
    """Generate as many vectors as ``lineitem`` holds, in the adapter's block
    layout (blocks 0..max inclusive, matrices = max line number), and check the
    structure: rows per (block, matrix) and that every coordinate is in range."""
    p = vectors(spark, sf_dir).agg(
        F.max("block_id").alias("blocks"), F.max("matrix_id").alias("block_size"), F.count(F.lit(1)).alias("rows")
    ).first()
    blocks, block_size = int(p["blocks"]), int(p["block_size"])
    multiplier = -(-int(p["rows"]) // ((blocks + 1) * block_size))  # the last matrices hold what is left
    g = generate_vectors(spark, blocks=blocks, block_size=block_size, multiplier=multiplier, rows=int(p["rows"]))
    in_range = F.lit(True)
    for c in XYZ:
        in_range = in_range & (F.min(c) >= -1000.0) & (F.max(c) < 1000.0)
    return g.groupBy("block_id", "matrix_id").agg(F.count(F.lit(1)).alias("n"), in_range.alias("in_range"))


def q_uniform_buckets(spark, sf_dir):
    """One draw in [-3, 3) per event; every truncated bucket -2..2 holds its share of
    the draws (a third for bucket 0, a sixth for the others) within six standard deviations."""
    e = table(spark, sf_dir, "events").select("event_id")
    d = uniform_draws(e, "event_id", -3.0, 3.0, seed=UNIFORM_SEED)
    n = d.groupBy(F.col("u").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # five rows
    total = F.sum("n").over(Window.partitionBy())
    p = F.when(F.col("bucket") == 0, 1 / 3).otherwise(1 / 6)
    return n.select("bucket", (F.abs(F.col("n") - total * p) <= 6 * F.sqrt(total * p * (1 - p))).alias("fair"))


def q_vec3_roundtrip(spark, sf_dir):
    """S3 (+ writer): lineitem vectors as planar files, read back."""
    return read_vec3(spark, _written_vec3(spark, sf_dir), columns=("block_id", "matrix_id", "row_id", *XYZ))


def q_vec3_block(spark, sf_dir):
    """S3 with a filter on the block: only that block's files are read."""
    return scan_vec3(spark, _written_vec3(spark, sf_dir), "block_id = 3")


def q_vectors_sink_roundtrip(spark, sf_dir):
    """K1: shifted vectors written to <dst>/results and read back."""
    path = write_vectors(ops.shift(vectors(spark, sf_dir)), scratch_dir(spark, "dst"))
    return spark.read.parquet(path)


def q_timed_run_report(spark, sf_dir):
    """What is certain of the reports of timed runs, eager and lazy: a row for each
    phase with a time of at least 0, overall as their sum and no more than an outer clock
    measures, settings that are known or empty."""
    _prepare(spark)
    out = []
    for mode, lazy in (("eager", False), ("lazy", True)):
        began = time.monotonic()
        run = run_pipeline(spark, vectors(spark, sf_dir), lazy=lazy, job_id=f"lineitem-{mode}")
        outer = time.monotonic() - began
        phases = {p: run.timings[p] for p in ("map", "shift", "average", "reduce")}
        # phases follow each other: together they last no longer than the run by another clock
        whole = abs(run.timings["overall"] - sum(phases.values())) < 1e-9 and 0 < run.timings["overall"] <= outer
        rows = spark.createDataFrame([(p, bool(t >= 0)) for p, t in phases.items()] + [("overall", whole)], "phase string, time_ok boolean")
        kept = run.report.select("experiment_id", "job_id", "generate", "blocks", "src", "dst", "lazy")
        out.append(rows.join(F.broadcast(kept)))  # the report is one row
    return out[0].unionByName(out[1])


def _written_vec3(spark, sf_dir):
    _prepare(spark)
    path = scratch_dir(spark, "vec3")
    write_vec3(vectors(spark, sf_dir), path)
    return path


def q_timed_run_src(spark, sf_dir):
    """S4 + X3: the pipeline's ``src`` mode over vector files of lineitem, eager and lazy."""
    path = _written_vec3(spark, sf_dir)
    return _run_results(spark, [(m, run_pipeline(spark, src=path, lazy=m == "lazy")) for m in ("eager", "lazy")])


def q_pipeline_dst(spark, sf_dir):
    """K1 in the pipeline: the shifted vectors that a run leaves in ``dst``, all columns."""
    _prepare(spark)
    dst = scratch_dir(spark, "pipeline-dst")
    run_pipeline(spark, vectors(spark, sf_dir), dst=dst)
    return spark.read.parquet(f"{dst}/results")


def q_scale_vectors_nd(spark, sf_dir):
    """P3 on arrays: 64-wide vectors divided by their label's number of vectors."""
    _prepare(spark)
    emb = table(spark, sf_dir, "embeddings")
    counts = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    j = join_key_counts(emb, counts, ["label"], "n")
    return ops.vector_scale(j, F.col("n"), array_col="embedding", out_col="v", width=WIDE).select("vec_id", "label", "v")


def q_timed_run_result(spark, sf_dir):
    """X3's answer and A7's phase counts from whole timed runs, eager and lazy
    (the timings themselves are in ``timed_run_report``)."""
    _prepare(spark)
    return _run_results(spark, [(m, run_pipeline(spark, vectors(spark, sf_dir), lazy=m == "lazy")) for m in ("eager", "lazy")])


def _run_results(spark, runs):
    rows = [(mode, *[run.result[f"sum_of_block_means_{c}"] for c in XYZ],
             run.counts["generate"], run.counts["shift"], run.counts["average"]) for mode, run in runs]
    df = spark.createDataFrame(rows, "mode string, sum_of_block_means_x double, sum_of_block_means_y double, "
                                     "sum_of_block_means_z double, generate_rows bigint, shift_rows bigint, "
                                     "average_rows bigint")
    return df.select("mode", *[_r(f"sum_of_block_means_{c}") for c in XYZ], "generate_rows", "shift_rows",
                     "average_rows")


# ---------------------------------------------------------------- report queries
def _written_reports(spark, sf_dir, fmt):
    _prepare(spark)
    rows = scratch_dir(spark, f"reports-{fmt}-rows")
    r = runs(spark, sf_dir).withColumn("__version", F.when(F.col("id") % 2 == 0, 1).otherwise(2))
    for part in portions(r):
        path = scratch_dir(spark, f"reports-{fmt}")
        write_report_files(part, path, fmt, version="__version", per_folder=PER_FOLDER)
        read_reports(spark, path, fmt).write.mode("append").parquet(rows)
        remove_report_files(spark, path)
        remove_scratch(spark, path)
    return spark.read.parquet(rows)


def q_reports_flatten(spark, sf_dir):
    """K2 + S5/S6/P8: per-run JSON report files (v1 and v2) read back flat."""
    return _written_reports(spark, sf_dir, "json")


def q_report_xml(spark, sf_dir):
    """K3 + S5: per-run XML report files (v1 and v2) read back flat."""
    return _written_reports(spark, sf_dir, "xml")


def _native_reports(spark, sf_dir, fmt):
    _prepare(spark)
    path = scratch_dir(spark, f"reports-native-{fmt}")
    r = runs(spark, sf_dir).withColumn("__version", F.when(F.col("id") % 2 == 0, 1).otherwise(2))
    write_reports(r, path, fmt, version="__version")
    return read_reports(spark, path, fmt, layout="records")


def q_report_json_native(spark, sf_dir):
    """K2 via Spark's JSON writer (record files) read back flat."""
    return _native_reports(spark, sf_dir, "json")


def q_report_xml_native(spark, sf_dir):
    """K3 via Spark's XML writer (record files) read back flat."""
    return _native_reports(spark, sf_dir, "xml")


def q_results_table(spark, sf_dir):
    """K4: the results table with ids 0..n-1 in job_id order, from record files, written and read back."""
    path = scratch_dir(spark, "results")
    write_results_table(results_table(_native_reports(spark, sf_dir, "json")), path)
    return spark.read.parquet(path)


def q_report_stream(spark, sf_dir):
    """S5 + K4 with a file stream over a report folder."""
    from vecflow.streaming.reports import ingest_reports

    _prepare(spark)
    src, out = scratch_dir(spark, "stream-src"), scratch_dir(spark, "stream-table")
    r = runs(spark, sf_dir).withColumn("__version", F.when(F.col("id") % 2 == 0, 1).otherwise(2))
    # ids go on from batch to batch, and portions in the order of job_id keep them in that order
    for part in portions(r):
        write_report_files(part, src, "json", version="__version", per_folder=PER_FOLDER)
        ingest_reports(spark, src, out, available_now=True)
        remove_report_files(spark, src)
    return spark.read.parquet(out).drop("batch")


def q_overall_sorted(spark, sf_dir):
    """O1 + P4/P5/P7/P9: all runs with size, partitions and seconds."""
    return rq.overall_sorted(runs(spark, sf_dir))


def q_overall_sorted_gb(spark, sf_dir):
    """O2 + F1: runs with base nparts = 4, ordered by gb."""
    return rq.overall_sorted_gb(runs(spark, sf_dir))


def q_overall_sum_gb(spark, sf_dir):
    """O3 + P6: the published overview."""
    return rq.overall_sum_gb(runs(spark, sf_dir))


def q_runs_by_nodes(spark, sf_dir):
    """runs on 16 nodes."""
    return rq.runs_by_nodes(runs(spark, sf_dir), nodes=16)


def q_runs_by_blocks_and_size(spark, sf_dir):
    """runs with a given blocks and block_size."""
    return rq.runs_by_blocks_and_size(runs(spark, sf_dir), blocks=48, block_size=128)


def q_distinct_blocks(spark, sf_dir):
    """Distinct block counts."""
    return rq.distinct_blocks(runs(spark, sf_dir))


def q_distinct_gb(spark, sf_dir):
    """A10: distinct data sizes."""
    return rq.distinct_gb(runs(spark, sf_dir))


def q_weak_series_for_blocks(spark, sf_dir):
    """one weak series, ``blocks = 48 and nparts = 4``."""
    return rq.series_for(runs(spark, sf_dir), "weak", 48)


def q_strong_series_for_gb(spark, sf_dir):
    """one strong series, ``gb = 6 and nparts = 4`` with gb a select alias."""
    return rq.series_for(runs(spark, sf_dir), "strong", 6)


def q_weak_series(spark, sf_dir):
    """G1: weak-scaling series."""
    return rq.weak_series(runs(spark, sf_dir))


def q_strong_series(spark, sf_dir):
    """Strong-scaling series."""
    return rq.strong_series(runs(spark, sf_dir))


def q_scaling_points(spark, sf_dir):
    """Plot feed for weak and strong scaling, all metrics."""
    return rq.scaling_points(runs(spark, sf_dir))


def q_export_tsv(spark, sf_dir):
    """K5: O1 exported as tab-separated text with header and read back."""
    df = rq.overall_sorted(runs(spark, sf_dir))
    path = export_text(df, scratch_dir(spark, "tsv"), sep="\t")
    return read_text(spark, path, df.schema, sep="\t")


def q_export_file(spark, sf_dir):
    """K5: O1 exported as one ordered file with one header, read back with each line's place in the file."""
    _prepare(spark)
    r = runs(spark, sf_dir)
    keys = ["cores", "block_size", "job_id", "id"]
    shown = rq.overall_sorted(r)
    path = export_file(r.select(*rq._sized(r), *keys), f"{scratch_dir(spark, 'file')}.tsv", ["nodes", "cores", "blocks", "block_size", "job_id", "id"])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    cells = F.split("value", "\t")
    return with_position(lines, ["block", "line"]).where("position > 1").select(
        (F.col("position") - 1).alias("position"), *[cells[k].cast(f.dataType).alias(f.name) for k, f in enumerate(shown.schema)])


def _catalog_results(spark, sf_dir) -> str:
    """The runs as a table of the session's catalog, replaced once; its name."""
    _prepare(spark)
    name = f"vecflow_results_{uuid.uuid4().hex[:8]}"
    folder = scratch_dir(spark, "catalog")
    write_results_table(runs(spark, sf_dir).limit(0), path=folder, table=name)
    write_results_table(runs(spark, sf_dir), path=folder, table=name)
    return name


def q_results_catalog(spark, sf_dir):
    """K4: the results as a catalog table: dropped, created and filled again, read by name."""
    return spark.table(_catalog_results(spark, sf_dir))


def q_results_sql_sorted(spark, sf_dir):
    """O1 as SQL text over the catalog table."""
    return results_view(spark, "sorted", _catalog_results(spark, sf_dir))


def q_results_sql_gb(spark, sf_dir):
    """O2 + F1 as SQL text with a named parameter over the catalog table."""
    return results_view(spark, "sorted_gb", _catalog_results(spark, sf_dir), nparts=4)


def q_results_sql_sum_gb(spark, sf_dir):
    """O3 as SQL text."""
    return results_view(spark, "sum_gb", _catalog_results(spark, sf_dir))


def q_results_sql_strong(spark, sf_dir):
    """F3 as SQL text: a filter on the computed ``gb``."""
    return results_view(spark, "strong", _catalog_results(spark, sf_dir), key=6, nparts=4)


def q_results_sql_weak(spark, sf_dir):
    """F2 as SQL text."""
    return results_view(spark, "weak", _catalog_results(spark, sf_dir), key=48, nparts=4)


def q_results_sql_filters(spark, sf_dir):
    """F4 and F5 as SQL text: rows of either, told apart."""
    name = _catalog_results(spark, sf_dir)
    one = results_view(spark, "by_nodes", name, nodes=16).withColumn("view", F.lit("by_nodes"))
    return one.unionByName(results_view(spark, "by_blocks_and_size", name, blocks=48, block_size=128).withColumn("view", F.lit("by_blocks_and_size")))


# Views whose order is part of the result: (rows of the view with the keys of its order, keys)
def _placed(spark, df, keys):
    _prepare(spark)
    return with_position(df, [*keys, "job_id", "id"]).drop("job_id", "id")


def q_overall_sorted_order(spark, sf_dir):
    """O1's order as a column: the place of each run."""
    return _placed(spark, runs(spark, sf_dir).select("nodes", "cores", "blocks", "block_size", "job_id", "id"), ["nodes", "cores", "blocks", "block_size"])


def q_overall_sorted_gb_order(spark, sf_dir):
    """O2's order as a column."""
    r = runs(spark, sf_dir).where("nparts = 4").select(rq.data_gb().alias("gb"), "nodes", "cores", "blocks", "block_size", "job_id", "id")
    return _placed(spark, r, ["gb", "nodes", "cores", "blocks", "block_size"])


def q_overall_sum_gb_order(spark, sf_dir):
    """O3's order as a column."""
    r = runs(spark, sf_dir).select(rq.sum_gb().alias("sum_gb"), "nodes", "cores", "blocks", "block_size", "job_id", "id")
    return _placed(spark, r, ["sum_gb", "nodes", "cores", "blocks", "block_size"])


def q_weak_series_order(spark, sf_dir):
    """G1's order as a column."""
    return _placed(spark, runs(spark, sf_dir).where("nparts = 4").select("blocks", "nodes", "job_id", "id"), ["blocks", "nodes"])


def q_strong_series_order(spark, sf_dir):
    """G2's order as a column."""
    r = runs(spark, sf_dir).where("nparts = 4").select(rq.data_gb().alias("gb"), "nodes", "job_id", "id")
    return _placed(spark, r, ["gb", "nodes"])


def q_distinct_order(spark, sf_dir):
    """A9's and A10's order as a column."""
    _prepare(spark)
    r = runs(spark, sf_dir)
    blocks = with_position(rq.distinct_blocks(r), ["blocks"]).select(F.lit("blocks").alias("kind"), F.col("blocks").cast("long").alias("value"), "position")
    return blocks.unionByName(with_position(rq.distinct_gb(r), ["gb"]).select(F.lit("gb").alias("kind"), F.col("gb").alias("value"), "position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shift_vectors": q_shift_vectors,
    "matrix_sums": q_matrix_sums,
    "matrix_means": q_matrix_means,
    "block_means": q_block_means,
    "block_means_hybrid": q_block_means_hybrid,
    "reduce_block_means": q_reduce_block_means,
    "global_mean": q_global_mean,
    "mean_of_block_means": q_mean_of_block_means,
    "phase_counts": q_phase_counts,
    "scale_vectors": q_scale_vectors,
    "vector_shift_nd": q_vector_shift_nd,
    "vector_sum_nd": q_vector_sum_nd,
    "scale_vectors_nd": q_scale_vectors_nd,
    "generate_structure": q_generate_structure,
    "uniform_buckets": q_uniform_buckets,
    "vec3_roundtrip": q_vec3_roundtrip,
    "vec3_block": q_vec3_block,
    "vectors_sink_roundtrip": q_vectors_sink_roundtrip,
    "timed_run_report": q_timed_run_report,
    "timed_run_result": q_timed_run_result,
    "timed_run_src": q_timed_run_src,
    "pipeline_dst": q_pipeline_dst,
    "reports_flatten": q_reports_flatten,
    "report_xml": q_report_xml,
    "report_json_native": q_report_json_native,
    "report_xml_native": q_report_xml_native,
    "results_table": q_results_table,
    "report_stream": q_report_stream,
    "overall_sorted": q_overall_sorted,
    "overall_sorted_gb": q_overall_sorted_gb,
    "overall_sum_gb": q_overall_sum_gb,
    "runs_by_nodes": q_runs_by_nodes,
    "runs_by_blocks_and_size": q_runs_by_blocks_and_size,
    "distinct_blocks": q_distinct_blocks,
    "distinct_gb": q_distinct_gb,
    "weak_series_for_blocks": q_weak_series_for_blocks,
    "strong_series_for_gb": q_strong_series_for_gb,
    "weak_series": q_weak_series,
    "strong_series": q_strong_series,
    "scaling_points": q_scaling_points,
    "export_tsv": q_export_tsv,
    "export_file": q_export_file,
    "results_catalog": q_results_catalog,
    "results_sql_sorted": q_results_sql_sorted,
    "results_sql_gb": q_results_sql_gb,
    "results_sql_sum_gb": q_results_sql_sum_gb,
    "results_sql_strong": q_results_sql_strong,
    "results_sql_weak": q_results_sql_weak,
    "results_sql_filters": q_results_sql_filters,
    "overall_sorted_order": q_overall_sorted_order,
    "overall_sorted_gb_order": q_overall_sorted_gb_order,
    "overall_sum_gb_order": q_overall_sum_gb_order,
    "weak_series_order": q_weak_series_order,
    "strong_series_order": q_strong_series_order,
    "distinct_order": q_distinct_order,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)
_RND = lambda c: f"round({c}, {DIGITS}) AS {c.split('.')[-1]}"

SQL_SHIFT = _with(SQL_V, SQL_SH) + "SELECT block_id, matrix_id, row_id, x, y, z FROM sh"
SQL_FLAT = _with(SQL_RUNS) + "SELECT " + ", ".join(FLAT_COLUMNS) + " FROM runs"
SQL_RESULTS = _with(SQL_RUNS) + (
    "SELECT CAST(row_number() OVER (ORDER BY job_id, experiment_id) - 1 AS INTEGER) AS id, "
    + ", ".join(FLAT_COLUMNS) + " FROM runs")
SQL_SIZED = """(CAST(blocks AS BIGINT) * block_size) // 1024 AS gb, nodes * cores * nparts AS nparts, nodes, blocks,
       block_size AS blk_sz, map_time / 1E9 AS rdd, shift_time / 1E9 AS rdd_shift, avg_time / 1E9 AS rdd_avg"""

ORACLE_SQL: dict[str, str] = {
    "shift_vectors": SQL_SHIFT,
    "matrix_sums": _with(SQL_V) + "SELECT block_id, matrix_id, count(*) AS n, "
    + ", ".join(f"round(sum({c}), {DIGITS}) AS {c}" for c in XYZ) + " FROM v GROUP BY block_id, matrix_id",
    "matrix_means": _with(SQL_V, SQL_SH, SQL_M) + "SELECT block_id, matrix_id, n, "
    + ", ".join(_RND(c) for c in XYZ) + " FROM m",
    "block_means": _with(SQL_V, SQL_SH, SQL_M, SQL_B) + "SELECT block_id, n_matrices, "
    + ", ".join(_RND(c) for c in XYZ) + " FROM b",
    "reduce_block_means": _with(SQL_V, SQL_SH, SQL_M, SQL_B) + "SELECT "
    + ", ".join(f"round(sum({c}), {DIGITS}) AS sum_of_block_means_{c}" for c in XYZ) + " FROM b",
    "global_mean": _with(SQL_V, SQL_SH) + "SELECT "
    + ", ".join(f"round(avg({c}), {DIGITS}) AS mean_{c}" for c in XYZ) + " FROM sh",
    "mean_of_block_means": _with(SQL_V, SQL_SH, SQL_M, SQL_B) + "SELECT "
    + ", ".join(f"round(avg({c}), {DIGITS}) AS mean_{c}" for c in XYZ) + " FROM b",
    "phase_counts": _with(SQL_V, SQL_SH) + "SELECT count(*) AS generate_rows, count(*) AS shift_rows, "
    "count(DISTINCT block_id) AS average_rows FROM sh",
    "scale_vectors": _with(SQL_V) + """SELECT v.block_id, v.matrix_id, v.row_id, v.x / c.n AS x, v.y / c.n AS y,
       v.z / c.n AS z FROM v JOIN (SELECT block_id, matrix_id, count(*) AS n FROM v GROUP BY block_id, matrix_id) c
       ON v.block_id = c.block_id AND v.matrix_id = c.matrix_id""",
    "vector_shift_nd": f"""SELECT vec_id, label,
       list_transform(CAST(embedding AS DOUBLE[]), lambda e, i: e + CAST(i - 1 AS DOUBLE) / {WIDE}.0) AS v
       FROM embeddings""",
    "vector_sum_nd": f"""SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(e), {DIGITS}) AS sum_v FROM (
       SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) AS pos
       FROM embeddings) GROUP BY label, pos""",
    "generate_structure": _with(SQL_V, """p AS (SELECT max(block_id) AS blocks, max(matrix_id) AS block_size,
       count(*) AS n, CAST(ceil(count(*) / ((max(block_id) + 1) * max(matrix_id))) AS BIGINT) AS multiplier FROM v)""")
    + """SELECT block_id, matrix_id, n, true AS in_range FROM (
       SELECT CAST(b.block_id AS BIGINT) AS block_id, CAST(mm.matrix_id AS INTEGER) AS matrix_id,
       CAST(least(p.multiplier, p.n - (b.block_id * p.block_size + mm.matrix_id) * p.multiplier) AS BIGINT) AS n
       FROM p, range(0, p.blocks + 1) b(block_id), range(0, p.block_size) mm(matrix_id)) WHERE n > 0""",
    "uniform_buckets": "SELECT CAST(b AS INTEGER) AS bucket, true AS fair FROM range(-2, 3) t(b)",
    "vec3_roundtrip": _with(SQL_V) + "SELECT * FROM v",
    "vec3_block": _with(SQL_V) + "SELECT * FROM v WHERE block_id = 3",
    "pipeline_dst": SQL_SHIFT,
    "scale_vectors_nd": """SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e / n) AS v
       FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)""",
    "timed_run_report": """SELECT p.phase, true AS time_ok, 'vecflow-timed-run' AS experiment_id, 'lineitem-' || m.mode AS job_id,
       CAST(NULL AS INTEGER) AS generate, CAST(NULL AS INTEGER) AS blocks, '' AS src, '' AS dst, m.lazy AS lazy
       FROM (VALUES ('map'), ('shift'), ('average'), ('reduce'), ('overall')) p(phase), (VALUES ('eager', 0), ('lazy', 1)) m(mode, lazy)
       WHERE (SELECT count(*) FROM lineitem) > 0""",
    "weak_series_for_blocks": _with(SQL_RUNS) + """SELECT blocks, nodes, map_time / 1E9 AS map_time,
       shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time FROM runs WHERE blocks = 48 AND nparts = 4 ORDER BY nodes""",
    "strong_series_for_gb": _with(SQL_RUNS) + """SELECT gb, nodes, map_time, shift_time, avg_time FROM (
       SELECT (CAST(blocks AS BIGINT) * block_size) // 1024 AS gb, nodes, map_time / 1E9 AS map_time,
       shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time, nparts FROM runs) s
       WHERE gb = 6 AND nparts = 4 ORDER BY nodes""",
    "vectors_sink_roundtrip": SQL_SHIFT,
    "reports_flatten": SQL_FLAT,
    "report_xml": SQL_FLAT,
    "report_json_native": SQL_FLAT,
    "report_xml_native": SQL_FLAT,
    "results_table": SQL_RESULTS,
    "report_stream": SQL_RESULTS,
    "overall_sorted": _with(SQL_RUNS) + f"SELECT {SQL_SIZED} FROM runs ORDER BY nodes, cores, blocks, block_size",
    "overall_sorted_gb": _with(SQL_RUNS) + f"""SELECT {SQL_SIZED} FROM runs WHERE runs.nparts = 4
       ORDER BY gb, nodes, cores, blocks, block_size""",
    "overall_sum_gb": _with(SQL_RUNS) + """SELECT (CAST(nodes AS BIGINT) * blocks * block_size) // 1024 AS sum_gb,
       nodes * cores * nparts AS partitions, nodes, blocks, block_size, map_time / 1E9 AS map_time_sec,
       shift_time / 1E9 AS shift_time_sec FROM runs ORDER BY sum_gb, nodes, cores, blocks, block_size""",
    "runs_by_nodes": _with(SQL_RUNS) + "SELECT * FROM runs WHERE nodes = 16",
    "runs_by_blocks_and_size": _with(SQL_RUNS) + "SELECT * FROM runs WHERE blocks = 48 AND block_size = 128",
    "distinct_blocks": _with(SQL_RUNS) + "SELECT DISTINCT blocks FROM runs ORDER BY blocks",
    "distinct_gb": _with(SQL_RUNS) + """SELECT DISTINCT (CAST(blocks AS BIGINT) * block_size) // 1024 AS gb
       FROM runs ORDER BY gb""",
    "weak_series": _with(SQL_RUNS) + """SELECT blocks, nodes, map_time / 1E9 AS map_time,
       shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time FROM runs WHERE nparts = 4
       ORDER BY blocks, nodes""",
    "strong_series": _with(SQL_RUNS) + """SELECT gb, nodes, map_time, shift_time, avg_time FROM (
       SELECT (CAST(blocks AS BIGINT) * block_size) // 1024 AS gb, nodes, map_time / 1E9 AS map_time,
       shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time, nparts FROM runs) s
       WHERE nparts = 4 ORDER BY gb, nodes""",
    "scaling_points": _with(SQL_RUNS, """w AS (SELECT 'weak' AS kind, CAST(blocks AS BIGINT) AS series, nodes,
       map_time / 1E9 AS map_time, shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time
       FROM runs WHERE nparts = 4)""",
                            """s AS (SELECT 'strong' AS kind, (CAST(blocks AS BIGINT) * block_size) // 1024 AS series,
       nodes, map_time / 1E9 AS map_time, shift_time / 1E9 AS shift_time, avg_time / 1E9 AS avg_time
       FROM runs WHERE nparts = 4)""", "ws AS (SELECT * FROM w UNION ALL SELECT * FROM s)")
    + """SELECT kind, series, nodes, 'map_time' AS metric, map_time AS t FROM ws
       UNION ALL SELECT kind, series, nodes, 'shift_time', shift_time FROM ws
       UNION ALL SELECT kind, series, nodes, 'avg_time', avg_time FROM ws""",
    "export_tsv": _with(SQL_RUNS) + f"SELECT {SQL_SIZED} FROM runs ORDER BY nodes, cores, blocks, block_size",
}
ORACLE_SQL["block_means_hybrid"] = ORACLE_SQL["block_means"]
ORACLE_SQL["timed_run_result"] = _with(SQL_V, SQL_SH, SQL_M, SQL_B, "r AS (SELECT " + ", ".join(
    f"round(sum({c}), {DIGITS}) AS sum_of_block_means_{c}" for c in XYZ) + """,
       (SELECT count(*) FROM sh) AS generate_rows, (SELECT count(*) FROM sh) AS shift_rows,
       count(*) AS average_rows FROM b)""") + """SELECT m.mode, r.* FROM r, (VALUES ('eager'), ('lazy')) m(mode)"""
ORACLE_SQL["timed_run_src"] = ORACLE_SQL["timed_run_result"]
ORACLE_SQL["results_catalog"] = _with(SQL_RUNS) + "SELECT * FROM runs"
ORACLE_SQL["results_sql_sorted"] = ORACLE_SQL["overall_sorted"]
ORACLE_SQL["results_sql_gb"] = ORACLE_SQL["overall_sorted_gb"]
ORACLE_SQL["results_sql_sum_gb"] = ORACLE_SQL["overall_sum_gb"]
ORACLE_SQL["results_sql_strong"] = ORACLE_SQL["strong_series_for_gb"]
ORACLE_SQL["results_sql_weak"] = ORACLE_SQL["weak_series_for_blocks"]
ORACLE_SQL["results_sql_filters"] = _with(SQL_RUNS) + """SELECT *, 'by_nodes' AS view FROM runs WHERE nodes = 16
       UNION ALL SELECT *, 'by_blocks_and_size' FROM runs WHERE blocks = 48 AND block_size = 128"""
ORACLE_SQL["export_file"] = _with(SQL_RUNS, f"""o AS (SELECT {SQL_SIZED},
       row_number() OVER (ORDER BY nodes, cores, blocks, block_size, job_id, id) AS position FROM runs)""") + "SELECT * FROM o"


def _place(keys: str, where: str = "true") -> str:
    names = ", ".join(k.rsplit(" AS ", 1)[-1] for k in keys.split("; "))
    return _with(SQL_RUNS, f"k AS (SELECT {keys.replace('; ', ', ')}, job_id, id FROM runs WHERE {where})") + (
        f"SELECT row_number() OVER (ORDER BY {names}, job_id, id) AS position, {names} FROM k")


_SQL_GB = "(CAST(blocks AS BIGINT) * block_size) // 1024 AS gb"
ORACLE_SQL["overall_sorted_order"] = _place("nodes; cores; blocks; block_size")
ORACLE_SQL["overall_sorted_gb_order"] = _place(f"{_SQL_GB}; nodes; cores; blocks; block_size", "nparts = 4")
ORACLE_SQL["overall_sum_gb_order"] = _place("(CAST(nodes AS BIGINT) * blocks * block_size) // 1024 AS sum_gb; nodes; cores; blocks; block_size")
ORACLE_SQL["weak_series_order"] = _place("blocks; nodes", "nparts = 4")
ORACLE_SQL["strong_series_order"] = _place(f"{_SQL_GB}; nodes", "nparts = 4")
ORACLE_SQL["distinct_order"] = _with(SQL_RUNS, "b AS (SELECT DISTINCT blocks FROM runs)", f"g AS (SELECT DISTINCT {_SQL_GB} FROM runs)") + """
       SELECT 'blocks' AS kind, CAST(blocks AS BIGINT) AS value, row_number() OVER (ORDER BY blocks) AS position FROM b
       UNION ALL SELECT 'gb', gb, row_number() OVER (ORDER BY gb) FROM g"""
