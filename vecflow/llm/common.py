"""Helpers shared by the operators: table access, vectorised word hashing,
block-wise sums of fixed-size arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecflow.session import ensure_checkpoint_dir, ship_package

# 64-bit mixing constants (public: splitmix64 finaliser and the golden-ratio odd multiplier).
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: odd base of the polynomial hash of a word's bytes
_BASE = 0x5851F42D4C957F2D
#: bytes of a batch that goes to or from Python, about (a longer row is a batch of its own)
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: bytes of text hashed at a time (bounds the 8-byte-per-byte work arrays)
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package importable on executors, batches of rows bounded by bytes.

    Spark's own bound (64 MiB) holds several times in a task, as rows, batches and
    results; a smaller one that the session sets is kept.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    digits, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(_BATCH_SETTING).lower()).groups()
    if not 0 < int(digits) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: numbers mixed at a time, so that the steps' arrays stay in a core's cache
_MIXED = 1 << 14


def mix64(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    if h.ndim == 1 and len(h) > _MIXED:
        out = np.empty(len(h), dtype=np.uint64)
        for k in range(0, len(h), _MIXED):
            out[k:k + _MIXED] = mix64(h[k:k + _MIXED])
        return out
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _power_table(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(_BASE)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = _power_table(4096)
#: bytes of text whose words' hashes are differences of one running sum
_HASH_BYTES = 1 << 15
#: powers of the base's inverse, which take a word's sum back to its first byte
_BACK = np.full(_HASH_BYTES + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
_BACK[0] = 1
np.multiply.accumulate(_BACK, out=_BACK)
#: a byte's number in a word's hash: one more than the byte, A-Z as a-z
_NUMBERS = np.arange(1, 257, dtype=np.uint64)
_NUMBERS[65:91] += np.uint64(32)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _power_table(2 * n)
    return _POWERS


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts.

    ``buf``: uint8 bytes of all texts; ``offsets``: n + 1 text boundaries.
    Returns word starts, word lengths and, per text, the index of its first word
    (n + 1 values). Words never cross a text boundary.
    """
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= word[ends]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z lower-cased; depends on the bytes only. Words rise and do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    ends, h = starts + lengths, np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        z = max(k + 1, int(np.searchsorted(ends, lo + _HASH_BYTES, side="right")))
        part = buf[lo:int(ends[z - 1])]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_NUMBERS[part] * _powers(len(part))[:len(part)], out=sums[1:])
        first = starts[k:z] - lo
        h[k:z] = (sums[ends[k:z] - lo] - sums[first]) * _BACK[first]
        k = z
    return mix64(h + lengths.astype(np.uint64) * _GOLDEN)


#: what operators keep in a Python worker from one task to the next
_CACHES: list[dict] = []


def kept_between_tasks(cache: dict) -> dict:
    """Registers a cache that ``free_caches`` empties."""
    _CACHES.append(cache)
    return cache


def free_caches() -> None:
    """Called where texts are hashed: an operator that does so has no use for what another one left in the worker."""
    for cache in _CACHES:
        cache.clear()


def text_slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of row numbers of about SLICE_BYTES of text each; a longer text is alone."""
    free_caches()
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def concat_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.cast(pa.binary() if pa.types.is_string(kind) else pa.large_binary())
    return [v if v is not None else b"" for v in column.to_pylist()]


def hashed_texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, word hashes) of each text, hashed slice by slice."""
    for lo, hi in text_slices(texts):
        buf, offsets = concat_texts(texts[lo:hi])
        starts, lengths, at = word_spans(buf, offsets)
        h = hash_words(buf, starts, lengths)
        for k in range(hi - lo):
            yield lo + k, h[at[k]:at[k + 1]]


def summed_blocks(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cells: int,
                  blocks: int = 64) -> np.ndarray:
    """Sum over all partitions of a fixed-size integer array that ``count`` makes of each.

    The array has ``cells`` entries whatever the data's size; partitions send it in
    ``blocks`` parts, parts are summed by Spark, and the driver gets the one array, whose
    size does not depend on the data.
    """
    width = cells // blocks

    def per_partition(batches):
        acc = np.asarray(count(batches), dtype=np.int64)
        for k in range(blocks):
            part = acc[k * width:(k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([_pack(part)], pa.binary())})

    def merge(batches):
        acc = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = _unpack(v, width)
                acc[k] = part if k not in acc else acc[k] + part
        for k, v in acc.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([_pack(v)], pa.binary())})

    parts = df.mapInArrow(per_partition, "k int, v binary").withColumn("p", F.expr("pmod(spark_partition_id(), 16)"))
    # two steps, so that no task reads the arrays of all partitions
    step = parts.repartition(blocks, "k", "p").select("k", "v").mapInArrow(merge, "k int, v binary")
    out = np.zeros(cells, dtype=np.int64)
    for r in step.repartition(blocks, "k").mapInArrow(merge, "k int, v binary").collect():
        out[r.k * width:(r.k + 1) * width] += _unpack(bytes(r.v), width)
    return out


def _pack(part: np.ndarray) -> bytes:
    """Smallest unsigned width that holds the values, named in the first byte."""
    top = int(part.max(initial=0))
    code, kind = next((c, k) for c, k, m in ((1, "<u1", 255), (2, "<u2", 65535), (4, "<u4", 2**32 - 1), (8, "<u8", 2**63)) if top <= m)
    return bytes([code]) + part.astype(kind).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1, count=width).astype(np.int64)


def input_partitions(spark: SparkSession) -> int:
    """Partitions for a keyed shuffle: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
