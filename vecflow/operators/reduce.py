"""Global reduce of block means and per-phase element counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def reduce_block_means(bm: DataFrame, cols: Sequence[str] = XYZ) -> DataFrame:
    """A5: element-wise SUM of the block averages (the reference prints this as
    'avg' but never divides by the block count; the names say what it is)."""
    return bm.agg(*[F.sum(c).alias(f"sum_of_block_means_{c}") for c in cols])


def phase_counts(vectors: DataFrame, shifted: DataFrame | None = None) -> DataFrame:
    """Elements after generate (rows), shift (rows) and average (blocks), each
    counted on its own phase's rows; a NULL block is a block.

    Row counts are partial counts, the block count a distinct aggregate that is
    de-duplicated inside each task before its shuffle. Without ``shifted`` the
    shift is taken over the same rows.
    """
    shifted = shifted if shifted is not None else vectors
    blocks = F.countDistinct("block_id") + F.max(F.col("block_id").isNull().cast("long"))
    first = vectors.agg(F.count(F.lit(1)).alias("generate_rows"), F.lit(0).cast("long").alias("shift_rows"),
                        F.lit(0).cast("long").alias("average_rows"))
    second = shifted.agg(F.lit(0).cast("long").alias("generate_rows"), F.count(F.lit(1)).alias("shift_rows"),
                         F.coalesce(blocks, F.lit(0)).alias("average_rows"))
    return first.unionByName(second).agg(*[F.sum(c).alias(c) for c in first.columns])
