"""Consecutive row ids 0..n-1 in a sort order, without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task.
Here the rows are range-sorted in parallel, each row gets its position inside
its partition, and a per-partition offset (one row per partition: a proven
size bound, so a broadcast is safe) turns that into a global position. The
sorted, positioned rows are checkpointed first so that recomputation after a
lost executor cannot reshuffle ties and change ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecflow.session import ensure_checkpoint_dir

_PID, _MONO, _OFF, _N = "__vf_pid", "__vf_mono", "__vf_off", "__vf_n"


def dense_index(df: DataFrame, order_by: Sequence[str], name: str = "id", start: int = 0,
                as_int: bool = True, stored: list | None = None) -> DataFrame:
    """``stored``: gets the path of the checkpoint, for callers that remove it when the rows are read no longer."""
    ensure_checkpoint_dir(df.sparkSession)
    # The range sort samples its input before sorting it: keep the input so the
    # source is read once (spills to disk if large; recomputable if lost).
    source = df.persist(StorageLevel.MEMORY_AND_DISK)
    placed = (
        source.orderBy(*order_by)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MONO, F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    source.unpersist()
    if stored is not None:
        stored.append(placed._jdf.logicalPlan().rdd().getCheckpointFile().get())
    offsets = (
        placed.groupBy(_PID)
        .agg(F.count(F.lit(1)).alias(_N))
        .withColumn(
            _OFF,
            F.coalesce(
                F.sum(_N).over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(_PID, _OFF)
    )
    pos = F.col(_OFF) + (F.col(_MONO) - F.shiftleft(F.col(_PID).cast("long"), 33)) + F.lit(start)
    out = placed.join(F.broadcast(offsets), _PID).withColumn(name, pos.cast("int") if as_int else pos)
    return out.select(name, *df.columns)
