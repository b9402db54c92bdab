"""S3: planar big-endian binary vector files as a Python Data Source.

File layout (fixed by the reference): float64 big-endian, planar -- all x,
then all y, then all z -- no header; ``rows = (bytes // 8) // 3``; trailing
bytes and trailing doubles are ignored. One file is one block; ``block_id``
is the file's position in the sorted listing.

Reading: the driver lists files and sizes only (like Spark's file index) and
cuts every file into row ranges; each task seeks to the three plane slices
of its range and yields Arrow batches. Planes missing from a user-given
schema are not read at all, and the option ``blocks`` (comma-separated ids)
leaves out the files of all other blocks. Filters are not pushed: Spark 4.1
keeps what one query pushed to a Python source for later queries over the same
DataFrame, which then miss rows.

Folders that ``sinks.vectors.write_vec3`` wrote hold blocks and matrices in their paths,
``block_id=3/matrix_id=1/chunk=.../kind=xyz/part-...``, with the rows' ids (int64,
big-endian) beside them under ``kind=ids``; any other folder is read as one block per
file. Spark's own writer made and committed those files, so readers need no list of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vecflow.sources.fs import filesystem as _filesystem, uri_prefix

FORMAT = "vec3"
DOUBLE_BYTES = 8
FILE_SCHEMA = "path string, block_id bigint, matrix_id int, row_id bigint, x double, y double, z double"
PLANES = ("x", "y", "z")
DEFAULT_ROWS_PER_SPLIT = 4 * 1024 * 1024  # ~96 MiB of vectors per task
DEFAULT_BATCH_ROWS = 256 * 1024  # ~10 MB per Arrow batch; measured 30% faster than 64 Ki
_PLACE = re.compile(r"/block_id=(-?\d+)/matrix_id=(-?\d+)/chunk=[^/]+/kind=(xyz|ids)/[^/]+$")


def _visible(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return not base.startswith(("_", "."))


def list_vector_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the data files at ``path`` (a file or a folder), sorted."""
    from pyarrow import fs as pafs

    filesystem, root = _filesystem(path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        entries = [info]
    else:
        entries = [
            e
            for e in filesystem.get_file_info(pafs.FileSelector(root, recursive=False))
            if e.type == pafs.FileType.File and _visible(e.path)
        ]
    prefix = uri_prefix(path, root)
    return sorted((prefix + e.path, e.size) for e in entries)


@dataclass
class Vec3File:
    path: str
    rows: int  # plane length
    block_id: int
    matrix_id: int = 0
    ids: str | None = None  # file of the row ids; without, a row's id is its position


def placed_files(path: str) -> list[Vec3File]:
    """Files that lie under block, matrix and chunk folders, with the ids beside them."""
    from pyarrow import fs as pafs

    filesystem, root = _filesystem(path)
    if filesystem.get_file_info(root).type != pafs.FileType.Directory:
        return []
    prefix = uri_prefix(path, root)
    found: dict[str, list] = {"xyz": [], "ids": []}
    for e in filesystem.get_file_info(pafs.FileSelector(root, recursive=True)):
        place = _PLACE.search(e.path)
        if place and e.type == pafs.FileType.File and _visible(e.path):
            found[place[3]].append((e.path.rsplit("/", 2)[0], prefix + e.path, e.size, int(place[1]), int(place[2])))
    ids = {f[0]: f[1] for f in found["ids"]}
    return [Vec3File(name, size // DOUBLE_BYTES // 3, block, matrix, ids.get(chunk)) for chunk, name, size, block, matrix in sorted(found["xyz"])]


def ids_beside(path: str) -> str | None:
    """The file of the row ids of one file of planes."""
    from pyarrow import fs as pafs

    filesystem, local = _filesystem(path)
    folder = local.rsplit("/", 2)[0] + "/kind=ids"
    if filesystem.get_file_info(folder).type != pafs.FileType.Directory:
        return None
    names = [e.path for e in filesystem.get_file_info(pafs.FileSelector(folder)) if e.type == pafs.FileType.File and _visible(e.path)]
    return uri_prefix(path, local) + names[0] if names else None


def vector_files(path: str) -> list[Vec3File]:
    return placed_files(path) or [Vec3File(p, size // DOUBLE_BYTES // 3, k) for k, (p, size) in enumerate(list_vector_files(path))]


@dataclass
class Vec3Split(InputPartition):
    file: Vec3File
    start: int
    end: int


class Vec3Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("vec3: a path is required")
        self.rows_per_split = int(options.get("rowsPerSplit", DEFAULT_ROWS_PER_SPLIT))
        self.batch_rows = int(options.get("batchRows", DEFAULT_BATCH_ROWS))
        self.fields = [f.name for f in schema.fields]
        unknown = set(self.fields) - {"path", "block_id", "matrix_id", "row_id", *PLANES}
        if unknown:
            raise ValueError(f"vec3: unknown columns {sorted(unknown)}")
        blocks = options.get("blocks")
        self.blocks = {int(b) for b in blocks.split(",") if b.strip()} if blocks is not None else None

    def partitions(self):
        splits = []
        for file in vector_files(self.path):
            if self.blocks is not None and file.block_id not in self.blocks:
                continue
            for start in range(0, file.rows, self.rows_per_split):
                splits.append(Vec3Split(file, start, min(file.rows, start + self.rows_per_split)))
        return splits or [Vec3Split(Vec3File("", 0, -1), 0, 0)]

    def read(self, split: Vec3Split):
        if split.end <= split.start:
            return
        file = split.file
        filesystem, local = _filesystem(file.path)
        planes = [p for p in PLANES if p in self.fields]
        with filesystem.open_input_file(local) as f:
            for lo in range(split.start, split.end, self.batch_rows):
                hi = min(split.end, lo + self.batch_rows)
                n = hi - lo
                cols = {}
                for p in planes:
                    offset = (PLANES.index(p) * file.rows + lo) * DOUBLE_BYTES
                    raw = f.read_at(n * DOUBLE_BYTES, offset)
                    cols[p] = pa.array(np.frombuffer(raw, dtype=">f8").astype(np.float64))
                if "path" in self.fields:
                    cols["path"] = pa.array([file.path] * n, pa.string())
                if "block_id" in self.fields:
                    cols["block_id"] = pa.array(np.full(n, file.block_id, dtype=np.int64))
                if "matrix_id" in self.fields:
                    cols["matrix_id"] = pa.array(np.full(n, file.matrix_id, dtype=np.int32))
                if "row_id" in self.fields:
                    cols["row_id"] = pa.array(self._row_ids(file, lo, hi))
                yield pa.RecordBatch.from_arrays([cols[c] for c in self.fields], names=self.fields)


    @staticmethod
    def _row_ids(file: Vec3File, lo: int, hi: int) -> np.ndarray:
        if file.ids is None:
            return np.arange(lo, hi, dtype=np.int64)
        filesystem, local = _filesystem(file.ids)
        with filesystem.open_input_file(local) as f:
            return np.frombuffer(f.read_at((hi - lo) * 8, lo * 8), dtype=">i8").astype(np.int64)


class Vec3DataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema: StructType):
        return Vec3Reader(self.options, schema)


def register(spark) -> None:
    """Make ``spark.read.format("vec3")`` available."""
    spark.dataSource.register(Vec3DataSource)
