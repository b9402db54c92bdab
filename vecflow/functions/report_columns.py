"""Columns of the run-report queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_S = 1e9
GB_DIVISOR = 1024


def ns_to_s(c: str | Column) -> Column:
    """Nanoseconds to seconds."""
    c = F.col(c) if isinstance(c, str) else c
    return c / F.lit(NS_PER_S)


def data_gb(blocks: str = "blocks", block_size: str = "block_size") -> Column:
    """P5: ``(blocks * block_size) / 1024`` with integer division (bigint)."""
    return F.expr(f"(cast({blocks} as bigint) * {block_size}) div {GB_DIVISOR}")


def sum_gb(nodes: str = "nodes", blocks: str = "blocks", block_size: str = "block_size") -> Column:
    """``(nodes * blocks * block_size) / 1024`` with integer division (bigint)."""
    return F.expr(f"(cast({nodes} as bigint) * {blocks} * {block_size}) div {GB_DIVISOR}")


def total_partitions(nodes: str = "nodes", cores: str = "cores", nparts: str = "nparts") -> Column:
    """``nodes * cores * nparts``."""
    return F.col(nodes) * F.col(cores) * F.col(nparts)


def strict_cast(c: Column, to: str, what: str = "value") -> Column:
    """Cast text to ``to``; NULL stays NULL, text that is not a number fails.

    Behaves the same whether or not ANSI mode is on, matching ``int(s)`` /
    ``float(s)`` that raise on bad text.
    """
    return F.when(c.isNull(), F.lit(None).cast(to)).otherwise(
        F.coalesce(
            F.trim(c).try_cast(to),
            F.raise_error(F.concat(F.lit(f"report {what} is not a valid {to}: "), c)).cast(to),
        )
    )
