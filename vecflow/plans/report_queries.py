"""Queries over the ``results`` table.

Each is one DataFrame plan; filters on base columns are applied before the
projection that reuses their names (F1), and select-aliases used in a filter
are computed first (F3). The reference ran one SQL query per series key and
looped in Python; here every series is a single pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.functions.report_columns import data_gb, ns_to_s, sum_gb, total_partitions

METRICS = ("map_time", "shift_time", "avg_time")
# Every run has its own: last sort keys, so that the runs of one configuration -- all
# equal in the published keys -- spread over many sort tasks, in a repeatable order.
TIE = ("job_id", "id")


def _sized(results: DataFrame) -> list:
    """gb, partitions (named nparts), nodes, blocks, blk_sz, and times in seconds."""
    return [
        data_gb().alias("gb"),
        total_partitions().alias("nparts"),
        F.col("nodes"),
        F.col("blocks"),
        F.col("block_size").alias("blk_sz"),
        ns_to_s("map_time").alias("rdd"),
        ns_to_s("shift_time").alias("rdd_shift"),
        ns_to_s("avg_time").alias("rdd_avg"),
    ]


def overall_sorted(results: DataFrame) -> DataFrame:
    """O1: every run, ordered by nodes, cores, blocks, block_size (cores not shown)."""
    ordered = results.orderBy("nodes", "cores", "blocks", "block_size", *TIE)
    return ordered.select(*_sized(ordered))


def overall_sorted_gb(results: DataFrame, nparts: int = 4) -> DataFrame:
    """O2 + F1: runs with base column ``nparts = 4``, ordered by gb first."""
    runs = results.filter(F.col("nparts") == nparts).withColumn("__gb", data_gb())
    ordered = runs.orderBy("__gb", "nodes", "cores", "blocks", "block_size", *TIE)
    return ordered.select(*_sized(ordered))


def overall_sum_gb(results: DataFrame) -> DataFrame:
    """O3 (published overview): sum_gb, partitions, map/shift seconds."""
    runs = results.withColumn("sum_gb", sum_gb())
    return runs.orderBy("sum_gb", "nodes", "cores", "blocks", "block_size", *TIE).select(
        "sum_gb",
        total_partitions().alias("partitions"),
        "nodes",
        "blocks",
        "block_size",
        ns_to_s("map_time").alias("map_time_sec"),
        ns_to_s("shift_time").alias("shift_time_sec"),
    )


def runs_by_nodes(results: DataFrame, nodes: int = 16) -> DataFrame:
    """``select * from results where nodes = 16``."""
    return results.filter(F.col("nodes") == nodes)


def runs_by_blocks_and_size(results: DataFrame, blocks: int = 1000, block_size: int = 1000) -> DataFrame:
    """``where blocks = B and block_size = S``."""
    return results.filter((F.col("blocks") == blocks) & (F.col("block_size") == block_size))


def distinct_blocks(results: DataFrame) -> DataFrame:
    """Distinct block counts, ordered."""
    return results.select("blocks").distinct().orderBy("blocks")


def distinct_gb(results: DataFrame) -> DataFrame:
    """A10: distinct data sizes, ordered."""
    return results.select(data_gb().alias("gb")).distinct().orderBy("gb")


def weak_series(results: DataFrame, nparts: int = 4) -> DataFrame:
    """G1 + F2: per ``blocks``, runs with nparts = 4 by nodes; times in seconds.

    The reference plotted ``avg_time`` from ``shift_time``; the real column is used.
    """
    runs = results.filter(F.col("nparts") == nparts).orderBy("blocks", "nodes", *TIE)
    return runs.select("blocks", "nodes", *[ns_to_s(m).alias(m) for m in METRICS])


def strong_series(results: DataFrame, nparts: int = 4) -> DataFrame:
    """Per data size ``gb``, runs with nparts = 4 by nodes; times in seconds."""
    runs = results.filter(F.col("nparts") == nparts).withColumn("__gb", data_gb()).orderBy("__gb", "nodes", *TIE)
    return runs.select(F.col("__gb").alias("gb"), "nodes", *[ns_to_s(m).alias(m) for m in METRICS])


def series_for(results: DataFrame, kind: str, key: int, nparts: int = 4) -> DataFrame:
    """One series by nodes: F2 ``blocks = key`` (weak) or F3 ``gb = key`` (strong; ``gb`` is a
    select alias of the reference, so here the expression itself is filtered), and nparts = 4."""
    if kind == "weak":
        return weak_series(results.filter(F.col("blocks") == key), nparts)
    if kind == "strong":
        return strong_series(results.filter(data_gb() == key), nparts)
    raise ValueError("kind is 'weak' or 'strong'")


def scaling_points(results: DataFrame, kinds=("weak", "strong"), metric: str | None = None,
                   nparts: int = 4) -> DataFrame:
    """Plot feed ``(kind, series, nodes, metric, t)`` for weak and strong scaling,
    long format; ``metric`` picks one of map_time, shift_time, avg_time.

    One scan: each run is expanded to its (kind, series key) pairs with
    ``inline`` and its metrics are unpivoted, instead of one query (or one
    union branch) per kind and metric.
    """
    metrics = list(METRICS)
    if metric is not None:
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        metrics = [metric]
    keys = {"weak": F.col("blocks").cast("bigint"), "strong": data_gb()}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), keys[k].alias("series")) for k in kinds])
    runs = results.filter(F.col("nparts") == nparts)
    wide = runs.select(F.inline(pairs), "nodes", *[ns_to_s(m).alias(m) for m in metrics])
    return wide.unpivot(["kind", "series", "nodes"], metrics, "metric", "t")


def scaling_series(results: DataFrame, kind: str = "weak", metric: str | None = None, nparts: int = 4) -> DataFrame:
    """G3 for one kind of report ("weak" or "strong"), optionally one metric."""
    if kind not in ("weak", "strong"):
        raise ValueError("kind is 'weak' or 'strong'")
    return scaling_points(results, kinds=(kind,), metric=metric, nparts=nparts)
