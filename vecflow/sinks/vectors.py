"""K1: write vectors to ``<dst>/results`` (the reference only made the folder)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLANES = ("x", "y", "z")
_FILE = pa.schema([("block_id", pa.int64()), ("matrix_id", pa.int32()), ("chunk", pa.string()), ("kind", pa.string()), ("value", pa.binary())])


def write_vectors(df: DataFrame, dst: str = ".", mode: str = "overwrite") -> str:
    """Parquet under ``<dst>/results``; returns the path written."""
    path = f"{dst.rstrip('/')}/results"
    df.write.mode(mode).parquet(path)
    return path


#: rows per planar file: 24 MiB of doubles, which a writing task holds as one value
MAX_ROWS_PER_FILE = 1 << 20


def write_vec3(df: DataFrame, path: str, mode: str = "overwrite", max_rows: int = MAX_ROWS_PER_FILE) -> str:
    """Planar big-endian files (readable with ``read_vec3``), block and matrix in their paths, row ids beside them.

    Rows are dealt by block and matrix with Spark's rebalancing, which cuts a matrix that
    holds many rows into several partitions and joins small ones. A task turns runs of up
    to ``max_rows`` rows of a matrix into one value each, and Spark's text writer makes
    one file of each value (its line end is a trailing byte, which the format ignores)
    and commits them; a failed task or job leaves nothing to be read.

    Without ``block_id``, ``matrix_id`` or ``row_id``, a partition is a block of one
    matrix, and ids are positions. NULL in any column raises: the format cannot hold it.
    """
    have = [c for c in ("block_id", "matrix_id", "row_id") if c in df.columns]
    keys = [c for c in have if c != "row_id"]
    rows = df.select(*have, *PLANES)
    if keys:
        rows = rows.hint("rebalance", *keys).sortWithinPartitions(*have)

    def run(batches):
        part = TaskContext.get().partitionId()
        held, key, n, seq, seen = [], None, 0, 0, 0

        def flush():
            table = pa.Table.from_batches(held)
            chunk = f"{part:05d}-{seq:05d}"
            planes = b"".join(table.column(p).to_numpy().astype(">f8").tobytes() for p in PLANES)
            for kind, value in (("xyz", planes), ("ids", table.column("row_id").to_numpy().astype(">i8").tobytes())):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([chunk]),
                                                  pa.array([kind]), pa.array([value], pa.binary())], names=_FILE.names)

        for b in batches:
            for name, column in zip(b.schema.names, b.columns):
                if column.null_count:
                    raise ValueError(f"vec3: {name} is NULL, which the file format cannot hold")
            m = b.num_rows
            given = {**{c: b.column(c) for c in b.schema.names}}
            for c, v in (("block_id", np.full(m, part, np.int64)), ("matrix_id", np.zeros(m, np.int32)), ("row_id", np.arange(seen, seen + m))):
                given.setdefault(c, pa.array(v))
            seen += m
            b = pa.RecordBatch.from_pydict(given)
            block, matrix = (b.column(c).to_numpy() for c in ("block_id", "matrix_id"))
            edge = np.flatnonzero((block[1:] != block[:-1]) | (matrix[1:] != matrix[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), m]):
                while lo < hi:
                    here = (int(block[lo]), int(matrix[lo]))
                    if n and (here != key or n >= max_rows):
                        yield from flush()
                        held, n, seq = [], 0, seq + 1
                    key, take = here, min(hi - lo, max_rows - (n if here == key else 0))
                    held.append(b.slice(lo, take))
                    n, lo = n + take, lo + take
        if n:
            yield from flush()

    files = rows.mapInArrow(run, "block_id long, matrix_id int, chunk string, kind string, value binary")
    files.withColumn("value", F.col("value").cast("string")).write.mode(mode).option("maxRecordsPerFile", 1).partitionBy(
        "block_id", "matrix_id", "chunk", "kind").text(path)
    return path
