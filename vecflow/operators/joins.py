"""Row-bounded broadcast: broadcast a side only when its size is proven small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.session import ensure_checkpoint_dir

# Rows of a narrow key/count table that may be broadcast: about 64 bytes per row
# in the hashed relation, so 4 Mi rows stay near 256 MiB.
DEFAULT_BROADCAST_ROWS = 4 * 1024 * 1024


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialise ``small`` once (reliable checkpoint in the shared folder) and
    count it exactly; return ``(broadcast(small), True)`` only if it has at
    most ``max_rows`` rows, else ``(small, False)`` for a shuffle join.

    Unlike Catalyst's estimate (an aggregate is estimated at its input's size),
    this bound is proven, and the side is computed only once either way.
    """
    ensure_checkpoint_dir(small.sparkSession)
    pinned = small.checkpoint(eager=True)
    if pinned.count() <= max_rows:
        return F.broadcast(pinned), True
    return pinned, False


def join_key_counts(big: DataFrame, counts: DataFrame, keys, count_col: str,
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Inner-join ``big`` with ``counts`` (one row per key of ``big``, ``count_col``
    = rows of ``big`` with that key) without moving a hot key into one task.

    * If the count table has at most ``max_broadcast_rows`` rows: one broadcast
      join, the big side is not shuffled.
    * Otherwise the keys are split by weight. A key holding more rows than one
      shuffle partition's fair share (``total / spark.sql.shuffle.partitions``)
      is hot; there are at most ``shuffle.partitions`` hot keys, so they are
      broadcast and their rows join in place. The remaining rows (no key above
      the fair share) join through a normal shuffle join.

    Keys are compared null-safely (a NULL key is a group like any other), so no
    row of ``big`` is lost. The second way scans ``big`` three times and shuffles
    its cold rows.
    """
    keys = list(keys)
    spark = big.sparkSession
    small, fits = bounded_broadcast(counts, max_broadcast_rows)
    if fits:
        return _null_safe_join(big, small, keys)
    total = small.agg(F.sum(count_col)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    fair = max(1, total // max(1, parts))
    hot = small.filter(F.col(count_col) > fair)        # <= parts rows: proven bound
    cold = small.filter(F.col(count_col) <= fair)
    hot_rows = _null_safe_join(big, F.broadcast(hot), keys)
    cold_rows = _null_safe_join(_null_safe_join(big, F.broadcast(hot.select(*keys)), keys, "left_anti"), cold, keys)
    return hot_rows.unionByName(cold_rows)


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__right_{k}" for k in keys])
