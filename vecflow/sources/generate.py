"""Generated vector blocks.

Rows come from ``spark.range`` split into ``nodes * cores * nparts``
partitions, the reference's partition count. Each row's block, matrix and
row ids are arithmetic on the global row index, and its coordinates are
hashes of that index, so there is no per-block array and no 2 GB limit:
a big block spreads over many tasks, and any partition recomputes to the
same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecflow.functions.random import uniform_double

# Fixed values of the reference workload.
MEGA_MULTIPLIER = 1024 * 1024  # vectors per matrix by default
DEFAULT_LOW, DEFAULT_HIGH = -1000.0, 1000.0  # coordinate range
DEFAULT_CORES = 12
# Upper bound on generated rows per task (about 400 MiB of vectors as rows),
# so a large generation gets more partitions than the reference's formula.
DEFAULT_MAX_ROWS_PER_PARTITION = 16 * 1024 * 1024

COORDS = ("x", "y", "z")


def block_count(blocks: int, inclusive: bool = True) -> int:
    """The reference generates ids ``0 to blocks`` inclusive: ``blocks + 1`` blocks."""
    return blocks + 1 if inclusive else blocks


def generate_vectors(
    spark: SparkSession,
    blocks: int = 1,
    block_size: int = 1,
    multiplier: int = MEGA_MULTIPLIER,
    nodes: int = 1,
    cores: int = DEFAULT_CORES,
    nparts: int = 1,
    low: float = DEFAULT_LOW,
    high: float = DEFAULT_HIGH,
    seed: int = 0,
    inclusive: bool = True,
    num_partitions: int | None = None,
    max_rows_per_partition: int = DEFAULT_MAX_ROWS_PER_PARTITION,
    rows: int | None = None,
) -> DataFrame:
    """``block_id BIGINT, matrix_id INT, row_id BIGINT, x, y, z DOUBLE``.

    ``block_size`` matrices per block, ``multiplier`` vectors per matrix. With
    ``rows``, exactly that many vectors: matrices are filled in order, the last
    ones only in part or not at all.
    Partitions: ``num_partitions`` if given, else ``nodes * cores * nparts``,
    raised so that no task generates more than ``max_rows_per_partition`` rows.
    """
    if blocks < 0 or block_size <= 0 or multiplier <= 0:
        raise ValueError("blocks >= 0, block_size > 0 and multiplier > 0 are required")
    per_block = block_size * multiplier
    total = block_count(blocks, inclusive) * per_block
    if rows is not None:
        if not 0 <= rows <= total:
            raise ValueError(f"rows must be between 0 and {total}, the vectors of all matrices")
        total = rows
    parts = num_partitions or max(1, nodes * cores * nparts, -(-total // max_rows_per_partition))
    idx = F.col("id")
    return spark.range(0, total, 1, parts).select(
        F.expr(f"id div {per_block}").alias("block_id"),
        F.expr(f"(id div {multiplier}) % {block_size}").cast("int").alias("matrix_id"),
        (idx % F.lit(multiplier)).alias("row_id"),
        *[uniform_double(seed, low, high, idx, F.lit(k)).alias(c) for k, c in enumerate(COORDS)],
    )


def uniform_draws(df: DataFrame, key: str, low: float, high: float, seed: int = 0,
                  name: str = "u") -> DataFrame:
    """One repeatable uniform draw per row of ``df``, keyed by column ``key``."""
    return df.withColumn(name, uniform_double(seed, low, high, F.col(key)))
