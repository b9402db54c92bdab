"""Removal of long repeated byte strings, by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else (in any
document, the same included) is removed.

Texts are dealt to suffix arrays so that equal strings always meet: each window of LENGTH
bytes belongs to the smallest hash among its ``GRAM``-byte grams, and a run of neighbouring
windows with the same smallest hash is one segment. Equal windows have equal smallest
hashes. Only segments whose gram occurs more than once go on; equal segments are one row
(all their windows repeat). A gram that occurs in more than ``SPLIT`` segments splits them
once more by a second hash, so a common line brings hardly any texts together; a group of
more than ``GROUP`` bytes of distinct segments is compared window by window through an
aggregation.

The segments of a few groups make one suffix array, by two-stage sorting: only suffixes
smaller than their successors are sorted directly, the others follow by a scan of the
buckets; neighbours whose common prefix reaches LENGTH are repeats.

Texts go through one shuffle, by row; both passes over them read it. Texts are told apart
by two 64-bit hashes, segments by one per gram, single windows by 128 bits.

Defined cases: a null text is empty (and stays null in ``deduplicated``), shorter texts than LENGTH lose nothing; repeated rows
are copies of each other and lose everything if long enough; a null id is a value like
any other; an empty table gives no rows; extra columns are ignored (kept by
``deduplicated``); texts of any length are read whole, in overlapping pieces; where a cut
leaves bytes that are no UTF-8, ``deduplicated`` drops the broken characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import as_bytes, concat_texts, input_partitions, mix64, text_slices
from vecflow.session import scratch_dir

LENGTH = 400
#: bytes of a gram, a power of two
GRAM = 32
#: a gram in more segments than this splits them by a second hash
SPLIT = 64
#: bytes of distinct segments that one suffix array may have of a group (each takes about 110 bytes of memory there)
GROUP = 512 << 10
#: bytes of a suffix array, about
ARRAY_BYTES = 256 << 10
#: bytes of one text that are hashed at a time
PIECE = 4 << 20
#: windows of one segment that are listed at a time
SLICE = 1 << 16
_ODD = 0x9E6C63D0876A9A47
_SECOND = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ segments
def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position (shorter by GRAM - 1 than ``buf``)."""
    h, step, base = buf.astype(np.uint64) + np.uint64(1), 1, _ODD
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
    return mix64(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours (shorter by w - 1 than ``x``)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def _pieces(texts: list[bytes], length: int):
    """(row, start in the text, bytes) of texts of at least ``length`` bytes; long ones in overlapping pieces."""
    for row, t in enumerate(texts):
        for lo in range(0, max(len(t) - length + 1, 0), PIECE):
            yield row, lo, t if len(t) <= PIECE else t[lo:lo + PIECE + length - 1]


def segments(texts: list[bytes], length: int = LENGTH):
    """Per slice: (rows, starts, ends, keys, grams, least, shift, buf) of its segments, rows rising.

    A segment's windows start at starts..ends - 1 of ``buf``, the slice's bytes, and
    ``shift`` further in the row's text; ``least`` is each window's smallest gram hash.
    """
    parts = list(_pieces(texts, length))
    for lo, hi in text_slices([p[2] for p in parts]):
        buf, offsets = concat_texts([p[2] for p in parts[lo:hi]])
        grams = gram_hashes(buf)
        low = sliding_min(grams, length - GRAM + 1)
        edge = np.ones(len(low), dtype=bool)
        edge[1:] = low[1:] != low[:-1]
        # windows across two texts belong to none
        valid = np.ones(len(low) + 1, dtype=np.int8)
        for end in offsets[1:-1]:
            valid[max(end - length + 1, 0):end] = 0
        valid[-1] = 0
        edge |= np.diff(valid[:-1], prepend=np.int8(0)) != 0
        at = np.flatnonzero(edge)
        stop = np.append(at[1:], len(low))
        keep = valid[at] == 1
        at, stop = at[keep], stop[keep]
        part = np.searchsorted(offsets, at, side="right") - 1
        rows = np.array([p[0] for p in parts[lo:hi]], dtype=np.int64)[part]
        shift = np.array([p[1] for p in parts[lo:hi]], dtype=np.int64)[part] - offsets[part]
        yield rows, at, stop, low[at], grams, low, shift, buf


def occurrences(grams: np.ndarray, low: np.ndarray, at: np.ndarray, stop: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """How often each segment's own gram occurs in it."""
    # grams that are the smallest of some window around them
    places = np.flatnonzero(_is_least(grams, low, length - GRAM + 1))
    values = grams[places]
    order = np.argsort(values, kind="stable")
    places, values = places[order], values[order]
    first, last = np.searchsorted(values, keys, side="left"), np.searchsorted(values, keys, side="right")
    out = np.ones(len(at), dtype=np.int64)
    for i in np.flatnonzero(last - first > 1).tolist():  # elsewhere the gram occurs once in the slice
        own = places[first[i]:last[i]]
        out[i] = max(1, np.searchsorted(own, stop[i] + length - GRAM) - np.searchsorted(own, at[i]))
    return out


def _is_least(grams: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Whether a gram equals the minimum of a window that holds it: the largest minimum around it."""
    pad = np.zeros(w - 1, dtype=low.dtype)
    around = ~sliding_min(~np.concatenate([pad, low, pad]), w)
    return grams == around


# ------------------------------------------------------------------ suffix array
def packed_words(data: bytes, big: bool = False) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros after the end)."""
    n, padded = len(data), data + bytes(15)
    out = np.empty(n, dtype=np.uint64)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(padded, dtype=">u8" if big else "<u8", offset=k, count=-(-(n - k) // 8))
    return out


def two_stage_suffixes(data: bytes, ends: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """Suffixes of at least ``least`` bytes to the end of their segment, in order of their first ``depth`` bytes.

    ``ends``: the (rising) ends of the segments that ``data`` consists of. Suffixes smaller
    than their successors are sorted directly; each other suffix is put into the next place
    of its first byte's bucket when the scan meets its successor. A bucket is scanned in
    waves: what precedes a finished stretch by a larger byte goes to later buckets at once,
    what precedes it by the bucket's own byte is the bucket's next stretch. Shorter suffixes
    take part only where the scan needs them: up to the first directly sorted one.
    """
    n = len(data)
    # with a smallest separator after each segment
    place = np.arange(n, dtype=np.int32)
    place += np.searchsorted(ends, place, side="right").astype(np.int32)
    m = n + len(ends)
    sep = np.zeros(m, dtype=np.int16)
    sep[place] = np.frombuffer(data, dtype=np.uint8)
    sep[place] += 1
    nxt = np.append(sep[1:], np.int16(0))
    # compared with the next position that differs from its successor
    spot = np.arange(m, dtype=np.int32)
    after = np.minimum.accumulate(np.where(sep != nxt, spot, np.int32(m - 1))[::-1])[::-1]
    smaller = sep[after] < nxt[after]
    smaller[sep == 0] = True
    origin = np.full(m, -1, dtype=np.int32)
    origin[place] = np.arange(n, dtype=np.int32)
    # positions from a segment's start to the first directly sorted one that is no earlier than its last window
    lows, marks = np.append(0, ends[:-1]), ends + np.arange(len(ends))
    long = ends - lows >= least
    direct_after = np.minimum.accumulate(np.where(smaller, spot, np.int32(m - 1))[::-1])[::-1]
    edge = np.zeros(m + 1, dtype=np.int32)
    edge[(lows + np.arange(len(ends)))[long]] = 1
    edge[direct_after[(marks - least)[long]] + 1] -= 1
    part = np.cumsum(edge[:-1], dtype=np.int32) > 0
    part[marks] = True
    del edge, direct_after, after, nxt
    direct = np.flatnonzero(smaller & part & (sep > 0))
    at = origin[direct]
    at = at[np.argsort(packed_words(data, True)[at], kind="stable")]  # nearly in order: the sort compares less
    limit = np.minimum(at + depth, ends[np.searchsorted(ends, at, side="right")])
    keys = [data[i:e] for i, e in zip(at.tolist(), limit.tolist())]
    direct = place[at[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]]
    del keys
    sizes = np.bincount(sep[part], minlength=257)
    stop = np.cumsum(sizes)
    head = stop - sizes
    sa = np.full(int(stop[-1]), -1, dtype=np.int32)
    sa[:sizes[0]] = marks
    head[0] = sizes[0]
    # directly sorted suffixes close their buckets, in order
    first = sep[direct]
    own = np.bincount(first, minlength=257)
    begin = stop - own
    sa[begin[first] + np.arange(len(direct)) - np.repeat(np.cumsum(own) - own, own)] = direct
    induced = part & ~smaller
    for c in np.flatnonzero(sizes).tolist():
        lo, done = int(stop[c] - sizes[c]), int(head[c])
        while lo < done:  # the bucket's own part, in waves
            lo, done = done, done + _induce(sa[lo:done], c, sep, induced, sa, head)
        _induce(sa[begin[c]:stop[c]], c, sep, induced, sa, head)
    result = origin[sa]
    result = result[result >= 0]
    return result[ends[np.searchsorted(ends, result, side="right")] - result >= least]


def _induce(found: np.ndarray, c: int, sep: np.ndarray, induced: np.ndarray, sa: np.ndarray, head: np.ndarray) -> int:
    """Puts what precedes the stretch ``found`` of bucket ``c`` in place, in order; how many went into ``c`` itself."""
    before = found[found > 0] - 1
    before = before[induced[before]]
    byte = sep[before]
    order = np.argsort(byte, kind="stable")
    before, byte = before[order], byte[order]
    cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))[:len(byte)]
    into = 0
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(byte)]):
        b = int(byte[a])
        sa[head[b]:head[b] + z - a] = before[a:z]
        head[b] += z - a
        into += (z - a) * (b == c)
    return into


def common_prefixes(data: bytes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, ``depth`` at most; both have so many bytes left."""
    words = packed_words(data)
    out = np.zeros(len(a), dtype=np.int64)
    on = np.arange(len(a))
    for k in range(0, depth, 8):
        differ = words[a[on] + k] ^ words[b[on] + k]
        low = differ & (~differ + np.uint64(1))  # its lowest bit is in the first byte that differs
        out[on] = k + np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        on = on[differ == 0]
    return np.minimum(out, depth)


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per part, which of its windows equal another window of any of the parts (booleans by start)."""
    data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
    window = two_stage_suffixes(data, ends, length, length).astype(np.int64)
    equal = np.flatnonzero(common_prefixes(data, window[:-1], window[1:], length) >= length)
    flags = np.zeros(len(data), dtype=bool)
    flags[window[equal]] = flags[window[equal + 1]] = True
    lo = ends - [len(p) for p in parts]
    return [flags[a:max(b - length + 1, a)] for a, b in zip(lo.tolist(), ends.tolist())]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


# ------------------------------------------------------------------ Spark
def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _grams_of(rows: DataFrame, length: int) -> DataFrame:
    """(k, d1, d2, n, grams, times) of each row: its segments' grams and how often each occurs."""
    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(3))
            grams, times = [[np.zeros(0, np.uint64)] for _ in texts], [[np.zeros(0, np.int64)] for _ in texts]
            for owner, at, stop, keys, hashes, low, _, _ in segments(texts, length):
                often = occurrences(hashes, low, at, stop, keys, length)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
                for a, z in zip(first, np.append(first[1:], len(owner)) if len(owner) else []):
                    grams[owner[a]].append(keys[a:z])
                    times[owner[a]].append(often[a:z])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([np.concatenate(g).view(np.int64) for g in grams], pa.list_(pa.int64())),
                 pa.array([np.concatenate(t) for t in times], pa.list_(pa.int64()))], names=["k", "d1", "d2", "n", "grams", "times"])

    return rows.select("k", "d1", "d2", "text").mapInArrow(run, "k long, d1 long, d2 long, n long, grams array<long>, times array<long>")


_SEGMENT = "key long, seg long, data binary, k long, d1 long, start long, windows int, again boolean"


def _segments_of(rows: DataFrame, length: int) -> DataFrame:
    """Segments whose gram is repeated (columns hot, split of the row); data once per partition and segment."""
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            ks, ds, hot, split = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), b.column(5)
            pick = [i for i in range(len(ks)) if hot[i].is_valid]
            texts = as_bytes(b.column(3).take(pa.array(pick, pa.int64())))
            wanted = [hot[i].values.to_numpy().view(np.uint64) for i in pick]
            wide = [split[i].values.to_numpy().view(np.uint64) for i in pick]
            for owner, at, stop, keys, grams, _, shift, buf in segments(texts, length):
                out = []
                second = None
                repeated, hot_gram = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(owner)]):
                    repeated[a:z] = np.isin(keys[a:z], wanted[owner[a]])
                    if len(wide[owner[a]]):
                        hot_gram[a:z] = np.isin(keys[a:z], wide[owner[a]])
                for i in np.flatnonzero(repeated).tolist():
                    row, a, z, key = int(owner[i]), int(at[i]), int(stop[i]), keys[i]
                    if hot_gram[i]:
                        # the same windows by a second hash of their grams
                        if second is None:
                            second = mix64(grams * _SECOND)
                        low = sliding_min(second[a:z + length - GRAM], length - GRAM + 1)
                        cut = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                        for c, e in zip(cut.tolist(), np.append(cut[1:], len(low)).tolist()):
                            again = np.count_nonzero(second[a + c:a + e + length - GRAM] == low[c]) > 1
                            out.append((mix64(key ^ low[c:c + 1])[0], row, a + c, a + e, shift[i], again))
                    else:
                        out.append((key, row, a, z, shift[i], np.count_nonzero(grams[a:z + length - GRAM] == key) > 1))
                cols = [[] for _ in range(8)]
                for key, row, a, z, s, again in out:
                    data = buf[a:z + length - 1].tobytes()
                    sid = xxhash.xxh3_64_intdigest(data)
                    new = (int(key), sid) not in seen
                    seen.add((int(key), sid))
                    for c, v in zip(cols, (key, sid, data if new else None, ks[pick[row]], ds[pick[row]], a + s, z - a, bool(again))):
                        c.append(v)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.array(cols[0], np.uint64)), _long(np.array(cols[1], np.uint64)), pa.array(cols[2], pa.binary()),
                         *(pa.array(c, pa.int64()) for c in cols[3:6]), pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.bool_())],
                        names=[c.split()[0] for c in _SEGMENT.split(", ")])

    return rows.mapInArrow(run, _SEGMENT)


_FOUND = "key long, seg long, starts array<int>, ends array<int>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "seg", "starts", "ends"])


def _by_suffix_arrays(distinct: DataFrame, length: int) -> DataFrame:
    """Repeated windows of distinct segments (key, seg, data), rows sorted by key; whole groups share an array."""
    def solve(group: list[tuple]) -> list[tuple]:
        out = []
        for (key, seg, _), flags in zip(group, repeated_windows([g[2] for g in group], length)):
            if flags.any():
                out.append((key, seg, *runs(flags)))
        return out

    def run(batches):
        group, size, at = [], 0, None
        for b in batches:
            done: list[tuple] = []
            for key, seg, data in zip(*(c.to_pylist() for c in b.columns)):
                if size >= ARRAY_BYTES and key != at:
                    done += solve(group)
                    group, size = [], 0
                group.append((key, seg, data))
                size += len(data)
                at = key
            yield _found(done)
        if group:
            yield _found(solve(group))

    return distinct.select("key", "seg", "data").mapInArrow(run, _FOUND)


def _by_windows(distinct: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one array: every window's 128-bit hash, written once and counted by Spark."""
    def run(batches):
        for b in batches:
            for key, seg, data in zip(*(c.to_pylist() for c in b.columns)):
                for lo in range(0, len(data) - length + 1, SLICE):
                    at = range(lo, min(lo + SLICE, len(data) - length + 1))
                    sums = [xxhash.xxh3_128_digest(data[i:i + length]) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([seg] * len(at), pa.int64()),
                                                      pa.array(at, pa.int32()), pa.array(sums, pa.binary())], names=["key", "seg", "i", "w"])

    path = scratch_dir(distinct.sparkSession, "windows")
    distinct.select("key", "seg", "data").mapInArrow(run, "key long, seg long, i int, w binary").write.parquet(path)
    windows = distinct.sparkSession.read.parquet(path)
    again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    hits = windows.join(again, "w").groupBy("key", "seg").agg(F.collect_list("i").alias("at"))

    def merge(batches):
        for b in batches:
            found = []
            for r in range(b.num_rows):
                at = np.sort(b.column(2)[r].values.to_numpy())
                edge = np.flatnonzero(np.diff(at) > 1)
                found.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + 1))
            yield _found(found)

    return hits.mapInArrow(merge, _FOUND)


def repeated_ranges(rows: DataFrame, grams: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, d1, ranges): per row, windows (from, to) that repeat; ``rows`` (k, d1, d2, text, doc) dealt by k, d1."""
    # one row per distinct text
    one = grams.groupBy("d1", "d2").agg(F.min(F.struct("k", "grams", "times")).alias("r"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    one = one.select("d1", "d2", "m", "n", "r.*").checkpoint()
    listed = one.select("k", "d1", F.explode(F.arrays_zip("grams", "times")).alias("x")).select(
        "k", "d1", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
    often = listed.groupBy("gram").agg(F.sum("times").alias("t")).where("t > 1")
    wanted = listed.select("k", "d1", "gram").distinct().join(often, "gram").groupBy("k", "d1").agg(
        F.collect_list("gram").alias("hot"), F.collect_list(F.when(F.col("t") > SPLIT, F.col("gram"))).alias("split"))
    marked = rows.join(wanted, ["k", "d1"], "left").select("k", "d1", "d2", "text", "hot", "split")
    # a table rather than a checkpoint: segments overlap, and compress well
    path = scratch_dir(rows.sparkSession, "segments")
    _segments_of(marked, length).write.option("compression", "zstd").parquet(path)
    found = rows.sparkSession.read.parquet(path)

    place = F.xxhash64("k", "d1", "start")
    kinds = found.groupBy("key", "seg").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("windows").alias("windows"),
                                             F.max("again").alias("again")).checkpoint()
    # equal segments in two places: all their windows repeat
    twice = kinds.where("lo != hi").select("key", "seg", F.array(F.lit(0)).alias("starts"), F.array("windows").alias("ends"))
    # equal windows have equal smallest grams: a group of one segment repeats only if its gram occurs in it again
    size = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again"),
                                    F.sum(F.col("windows") + (length - 1)).alias("bytes")).where("c > 1 or again").checkpoint()
    data = found.where("data is not null").select("key", "seg", "data").join(size.select("key", "bytes"), "key")
    data = data.groupBy("key", "seg").agg(F.max("data").alias("data"), F.max("bytes").alias("bytes"))
    parts = input_partitions(rows.sparkSession)
    few = data.where(F.col("bytes") <= GROUP).repartition(parts, "key").sortWithinPartitions("key", "seg")
    repeats = twice.unionByName(_by_suffix_arrays(few, length))
    if not size.where(F.col("bytes") > GROUP).isEmpty():
        repeats = repeats.unionByName(_by_windows(data.where(F.col("bytes") > GROUP), length))
    flat = repeats.select("key", "seg", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select(
        "key", "seg", F.col("x.starts").alias("a"), F.col("x.ends").alias("z"))
    places = found.select("key", "seg", "k", "d1", "start").join(flat, ["key", "seg"]).select(
        "k", "d1", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))
    copies = one.where("m > 1").select("d1", "d2")
    whole = grams.join(copies, ["d1", "d2"]).where(F.col("n") >= length).select("k", "d1", F.lit(0).cast("long").alias("a"), (F.col("n") - length + 1).alias("z"))
    return places.unionByName(whole).distinct().groupBy("k", "d1").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("ranges"))


def cut_texts(texts: list[bytes], ranges: list, length: int) -> list[tuple[bytes, int, int]]:
    """(what is left, bytes removed, runs removed) of each text; ranges are of window starts."""
    out = []
    for t, r in zip(texts, ranges):
        spans: list[list[int]] = []
        for x in r or ():
            a, z = x["a"], x["z"] + length - 1
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        left, at = [], 0
        for a, z in spans:
            left.append(t[at:a])
            at = z
        left.append(t[at:])
        out.append((b"".join(left), sum(z - a for a, z in spans), len(spans)))
    return out


def _dealt(docs: DataFrame, text: str, id: str) -> DataFrame:
    key = F.coalesce(F.xxhash64(F.col(id)), F.lit(0))
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key.alias("k"), F.coalesce(F.xxhash64(body), F.lit(0)).alias("d1"), F.coalesce(F.xxhash64(F.lit("second"), body), F.lit(0)).alias("d2"),
                       body.alias("text"), F.col(text).isNull().alias("blank"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest"))


def _with_ranges(docs: DataFrame, length: int, text: str, id: str) -> DataFrame:
    rows = _dealt(docs, text, id)
    grams = _grams_of(rows, length).checkpoint()
    ranges = repeated_ranges(rows, grams, length).checkpoint()
    return rows.join(ranges, ["k", "d1"], "left")


def removal_report(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            done = cut_texts(texts, b.column(2).to_pylist(), length)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())],
                names=[id, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_ranges(docs.select(F.col(id), F.col(text)), length, text, id)
    return rows.select(F.col(f"rest.`{id}`").alias(id), "text", "ranges").mapInArrow(
        run, f"`{id}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents with repeated strings removed from their texts; all other columns as they are, rows stay."""
    def run(batches):
        for b in batches:
            done = cut_texts(as_bytes(b.column(0)), b.column(1).to_pylist(), length)
            left = [None if blank else d[0].decode(errors="ignore") for d, blank in zip(done, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), b.column(2)], names=["text", "rest"])

    rows = _with_ranges(docs, length, text, id)
    inner = rows.schema["rest"].dataType.simpleString()
    cut = rows.select("text", "ranges", "rest", "blank").mapInArrow(run, f"text string, rest {inner}")
    return cut.select(*(F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
