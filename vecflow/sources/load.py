"""Choose the vector source -- generate wins over ``src``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType

from vecflow.sources import vec3
from vecflow.sources.generate import generate_vectors

VECTOR_COLUMNS = ("block_id", "matrix_id", "row_id", "x", "y", "z")


def read_vec3(spark: SparkSession, src: str, columns=("path", "block_id", "matrix_id", "row_id", "x", "y", "z"),
              **options) -> DataFrame:
    """Planar binary files as vectors: blocks, matrices and row ids as written, or, for
    files of other writers, one block of one matrix per file.

    Python Data Sources get no column pruning from Catalyst, so the wanted
    ``columns`` are passed to the source as its schema: unrequested planes are
    not read and no per-row ``path`` string is built unless asked for.

    Unless ``rowsPerSplit`` is given, a task reads as many vectors as fit in
    ``spark.sql.files.maxPartitionBytes`` (24 bytes per vector), like Spark's
    own file sources.
    """
    vec3.register(spark)
    types = {"path": "string", "block_id": "bigint", "matrix_id": "int", "row_id": "bigint", "x": "double",
             "y": "double", "z": "double"}
    wanted = [c for c in types if c in columns]
    if "rowsPerSplit" not in options:
        max_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
        options["rowsPerSplit"] = max(1, _bytes(max_bytes) // (3 * vec3.DOUBLE_BYTES))
    reader = spark.read.format(vec3.FORMAT).schema(", ".join(f"{c} {types[c]}" for c in wanted))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(src)


def scan_vec3(spark: SparkSession, src: str, where: str | None = None, columns=VECTOR_COLUMNS) -> DataFrame:
    """Files of ``write_vec3`` as vectors; ``where`` is a filter on ``block_id`` and ``matrix_id``.

    Paths and lengths come from Spark's own scan of the folder (contents are not read
    there), and block and matrix are its partition columns: Catalyst turns ``where`` into a
    filter on folders, so files of other blocks are neither listed as input nor opened.
    Each call has its own scan; nothing one query asked for is kept for another. A task
    gets files of about ``spark.sql.files.maxPartitionBytes`` together, reads the planes
    that ``columns`` names, a file after the other, and yields them in batches.
    """
    files = spark.read.format("binaryFile").load(src).where("kind = 'xyz' and length >= 24")
    files = files.select("path", "length", F.col("block_id").cast("long").alias("block_id"), F.col("matrix_id").cast("int").alias("matrix_id"))
    if where:
        files = files.where(where)
    wanted = [c for c in VECTOR_COLUMNS if c in columns]
    kinds = {"block_id": "long", "matrix_id": "int", "row_id": "long", "x": "double", "y": "double", "z": "double"}

    def run(batches):
        reader = vec3.Vec3Reader({"path": src}, StructType([StructField(c, NullType()) for c in wanted]))
        for b in batches:
            for path, length, block, matrix in zip(*(c.to_pylist() for c in b.columns)):
                file = vec3.Vec3File(path, length // 24, block, matrix, vec3.ids_beside(path) if "row_id" in wanted else None)
                yield from reader.read(vec3.Vec3Split(file, 0, file.rows))

    return files.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    t = str(text).strip().lower().rstrip("b") or "0"
    if t[-1] in units:
        return int(float(t[:-1]) * units[t[-1]])
    return int(t)


def load_vectors(spark: SparkSession, generate: bool = False, src: str | None = None, columns=VECTOR_COLUMNS,
                 **generate_options) -> DataFrame:
    """Vectors from the generator or from files; ``columns``: what is built (and, of files, read)."""
    if generate:
        return generate_vectors(spark, **generate_options).select(*columns)
    if src:
        return read_vec3(spark, src, columns=columns).select(*columns)
    raise ValueError("no vector source: pass generate=True or src=<path>")
