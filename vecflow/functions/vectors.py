"""Array-column vector arithmetic (P2, P3 for general width).

For a known, modest width the result is built element by element
(``v[i] + d_i``), which stays inside whole-stage codegen; wide vectors use
the higher-order ``zip_with`` / ``transform`` forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above this width the element-wise form makes generated methods too large.
ELEMENTWISE_MAX_WIDTH = 128


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_add(v: str | Column, displacement: Sequence[float]) -> Column:
    """Element-wise ``v + displacement``; a width mismatch raises at run time.

    ``zip_with`` alone would pad the shorter side with NULL, so the width is
    checked explicitly, as the reference's ``require`` does.
    """
    v = _as_col(v).cast("array<double>")
    n = len(displacement)
    if n == 0:
        raise ValueError("empty displacement vector")
    if n <= ELEMENTWISE_MAX_WIDTH:
        shifted = F.array(*[v[i] + F.lit(float(d)) for i, d in enumerate(displacement)])
    else:
        d = F.array(*[F.lit(float(x)) for x in displacement])
        shifted = F.zip_with(v, d, lambda a, b: a + b)
    bad = F.raise_error(
        F.concat(F.lit(f"vector width differs from displacement width {n}: "), F.size(v).cast("string"))
    )
    return F.when(v.isNull(), F.lit(None).cast("array<double>")).when(F.size(v) == n, shifted).otherwise(bad)


def array_scale(v: str | Column, divisor: float | Column, width: int | None = None) -> Column:
    """Element-wise ``v / divisor`` (P3). With ``width`` given, an array of another width raises at run time."""
    v = _as_col(v).cast("array<double>")
    div = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    if width is None:
        return F.transform(v, lambda e: e / div)
    if width <= ELEMENTWISE_MAX_WIDTH:
        scaled = F.array(*[v[i] / div for i in range(width)])
    else:
        scaled = F.transform(v, lambda e: e / div)
    bad = F.raise_error(F.concat(F.lit(f"vector width differs from the given width {width}: "), F.size(v).cast("string")))
    return F.when(v.isNull(), F.lit(None).cast("array<double>")).when(F.size(v) == width, scaled).otherwise(bad)
