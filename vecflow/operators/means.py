"""Matrix sums/means, block means, global means, wide sums.

Every average is algebraic, so Spark aggregates partially inside each task
before the shuffle: only one row per (task, group) crosses the network, and a
hot block or matrix -- even one holding a third of all rows -- is split over
every task that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.operators.joins import DEFAULT_BROADCAST_ROWS, join_key_counts

XYZ = ("x", "y", "z")
MATRIX_KEYS = ("block_id", "matrix_id")
METHODS = ("functional", "hybrid")


def matrix_sums(df: DataFrame, cols: Sequence[str] = XYZ) -> DataFrame:
    """A1: column sums and row count of each matrix."""
    return df.groupBy(*MATRIX_KEYS).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols])


def matrix_means(df: DataFrame, cols: Sequence[str] = XYZ) -> DataFrame:
    """A2: column means and row count of each matrix."""
    return df.groupBy(*MATRIX_KEYS).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def _partial_sums_arrow(cols: Sequence[str]):
    """Per Arrow batch: one (block, matrix) row of row count, and per column the
    sum and count of non-null values (so means skip NULLs exactly as ``avg``)."""
    keys = list(MATRIX_KEYS)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            grouped = pa.Table.from_batches([batch]).group_by(keys).aggregate(
                [([], "count_all")] + [(c, "sum") for c in cols] + [(c, "count") for c in cols])
            names = keys + ["n"] + [f"{c}_sum" for c in cols] + [f"{c}_count" for c in cols]
            arrays = [grouped.column(k) for k in keys] + [grouped.column("count_all")] + [
                grouped.column(f"{c}_sum") for c in cols] + [grouped.column(f"{c}_count") for c in cols]
            yield from pa.Table.from_arrays(arrays, names=names).to_batches()

    return run


def matrix_means_hybrid(df: DataFrame, cols: Sequence[str] = XYZ) -> DataFrame:
    """A4 'hybrid': per-batch partial sums in Arrow (constant memory per task),
    then a native final sum per matrix."""
    schema = ", ".join(["block_id long", "matrix_id int", "n long"] + [f"{c}_sum double" for c in cols]
                       + [f"{c}_count long" for c in cols])
    partial = df.select(*MATRIX_KEYS, *cols).mapInArrow(_partial_sums_arrow(cols), schema)
    return partial.groupBy(*MATRIX_KEYS).agg(
        F.sum("n").alias("n"),
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_count")).alias(c) for c in cols])


def block_means(df: DataFrame, method: str = "functional", cols: Sequence[str] = XYZ,
                with_rows: bool = False) -> DataFrame:
    """A3: block average = unweighted mean of its matrix means.

    ``with_rows`` adds ``n_rows`` (vectors per block), a by-product of the
    matrix counts that lets callers count rows without another pass.
    """
    if method == "functional":
        mm = matrix_means(df, cols)
    elif method == "hybrid":
        mm = matrix_means_hybrid(df, cols)
    else:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    extra = [F.sum("n").alias("n_rows")] if with_rows else []
    return mm.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_matrices"), *extra, *[F.avg(c).alias(c) for c in cols])


def choose_method(functional: bool = False, hybrid: bool = False, imperative: bool = False) -> str:
    """A4 precedence: functional > hybrid > imperative > functional (default).

    The reference's third (row-loop) form computes the same block means; it maps
    to the native plan here.
    """
    if functional:
        return "functional"
    if hybrid:
        return "hybrid"
    return "functional"


def global_mean(df: DataFrame, weighted: bool = True, cols: Sequence[str] = XYZ) -> DataFrame:
    """The global average; ``weighted`` = over all rows, else the mean of block means."""
    if weighted:
        return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    return block_means(df, cols=cols).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def scale_by_matrix_rows(df: DataFrame, cols: Sequence[str] = XYZ,
                         max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """P3 as the reference uses it: every vector divided by its matrix's row count
    (the per-row share of the matrix mean). Counts come from a partial
    aggregation and are materialised; the count table (one row per matrix) is
    broadcast when its exact row count is under the bound, otherwise hot
    matrices are split from the rest (see ``joins.join_key_counts``)."""
    counts = df.groupBy(*MATRIX_KEYS).agg(F.count(F.lit(1)).alias("__n"))
    joined = join_key_counts(df, counts, MATRIX_KEYS, "__n", max_broadcast_rows)
    return joined.withColumns({c: F.col(c) / F.col("__n") for c in cols}).drop("__n")


def vector_sum_nd(df: DataFrame, array_col: str, keys: Sequence[str] = (), value_name: str = "sum_v") -> DataFrame:
    """Element-wise sum of an array column per key -> (keys..., pos, sum_v), ``pos`` 0-based.

    Elements are exploded by position and summed with a partial aggregation on
    (keys, pos): explode and partial sum fuse into one codegen stage, and only
    one row per (task, key, pos) is shuffled. (Measured faster than one
    aggregate column per element, which leaves codegen, and than the ML
    ``Summarizer``.)

    All arrays of a key must have one width; another width raises at run time
    (every array meets its key's others at position 0, where the widths are
    compared). NULL arrays add nothing, as NULL does to a sum.
    """
    keys = list(keys)
    exploded = df.select(*keys, F.size(array_col).alias("__w"),
                         F.posexplode(F.col(array_col).cast("array<double>")).alias("pos", "__e"))
    sums = exploded.groupBy(*keys, "pos").agg(F.sum("__e").alias("__s"), F.min("__w").alias("__lo"), F.max("__w").alias("__hi"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("vectors of different widths cannot be added:"),
                                    F.col("__lo").cast("string"), F.col("__hi").cast("string"))).cast("double")
    return sums.select(*keys, "pos", F.when(F.col("__lo") == F.col("__hi"), F.col("__s")).otherwise(bad).alias(value_name))
