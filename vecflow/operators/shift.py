"""Displacement and scaling of vectors (narrow projections)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecflow.functions.vectors import array_add, array_scale

# Fixed value of the reference workload: the displacement added to every vector.
SHIFT = (25.25, -12.125, 6.333)
XYZ = ("x", "y", "z")


def shift(df: DataFrame, displacement: Sequence[float] = SHIFT, cols: Sequence[str] = XYZ) -> DataFrame:
    """Add ``displacement`` to the coordinate columns; the widths must agree."""
    if len(displacement) != len(cols):
        raise ValueError(f"displacement has width {len(displacement)}, vectors have width {len(cols)}")
    return df.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in zip(cols, displacement)})


def vector_shift(df: DataFrame, displacement: Sequence[float], array_col: str = "v",
                 out_col: str | None = None) -> DataFrame:
    """General-width row-broadcast add on an array column; a width mismatch fails."""
    return df.withColumn(out_col or array_col, array_add(array_col, displacement))


def scale(df: DataFrame, divisor: float | str | Column, cols: Sequence[str] = XYZ) -> DataFrame:
    """Divide the coordinate columns by a number or by a per-row column."""
    div = F.col(divisor) if isinstance(divisor, str) else (
        divisor if isinstance(divisor, Column) else F.lit(float(divisor)))
    return df.withColumns({c: F.col(c) / div for c in cols})


def vector_scale(df: DataFrame, divisor: float | Column, array_col: str = "v", out_col: str | None = None,
                 width: int | None = None) -> DataFrame:
    """P3 on an array column."""
    return df.withColumn(out_col or array_col, array_scale(array_col, divisor, width))
