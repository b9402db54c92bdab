"""Repeatable uniform doubles as a pure column expression.

The value depends only on ``(seed, *keys)``, never on partitioning or task
order, so a lost partition recomputes to identical data. ``rand(seed)`` does
not have that property (it is seeded per partition).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 53
_MASK = (1 << _BITS) - 1
_SCALE = float(1 << _BITS)


def unit_double(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1) from the low 53 bits of xxhash64(seed, keys)."""
    h = F.xxhash64(F.lit(int(seed)), *keys)
    return h.bitwiseAND(F.lit(_MASK)).cast("double") / F.lit(_SCALE)


def uniform_double(seed: int, low: float, high: float, *keys: Column) -> Column:
    """``low + (high - low) * u`` with ``u`` uniform in [0, 1)."""
    if not high > low:
        raise ValueError(f"need low < high, got [{low}, {high})")
    return F.lit(float(low)) + F.lit(float(high - low)) * unit_double(seed, *keys)
