"""Best-fit packing of token sequences by linear grouping.

Every document becomes its ids followed by one separator id; only documents longer
than the capacity are cut, into full pieces and one shorter last piece. Pieces are
dealt to shards by a hash of their place (about ``SHARD_PIECES`` each, so a
shard fits one task at any corpus size) and each shard is packed by the linear
grouping scheme:

1. large lengths are sorted and divided into groups of equal cardinality, each
   rounded up to its group's largest length;
2. few-size configurations (how many of each rounded length share a sequence) are
   chosen by a bounded knapsack for the best fill, each used as often as the
   remaining counts allow;
3. actual pieces are substituted for rounded ones, longest first;
4. the freed room, the small pieces and those of configurations that rounding left weak:
   best fit, decreasing.

Shards lose at most a partly filled sequence or so each, against about
``SHARD_PIECES`` pieces.

Defined cases: a null text is the empty text (one piece, the separator alone);
repeated rows are packed as separate pieces; a null doc_id is kept; documents of
any length are cut into pieces; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.bpe import loaded, read_tokenizer

CAPACITY = 2048
#: lengths over this share of the capacity are large
LARGE_SHARE = 1 / 8
#: large pieces per group, about: groups of equal cardinality among the large lengths
GROUP_PIECES = 4
#: a configuration that its actual pieces fill to less than this is opened again
WEAK = 0.98
#: pieces per shard, about
SHARD_PIECES = 60_000


def piece_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0,
                    text: str = "text", id: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per piece: doc id, piece, start, length, CRC-32 of its ids (and the ids themselves if asked)."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kind = docs.schema[id].dataType.simpleString()
    end = int(separator).to_bytes(4, "little")

    def run(batches):
        bpe = loaded(spec.value)
        for batch in batches:
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                rest, done, n = bytearray(), 0, 0
                parts = itertools.chain(bpe.windows(t or ""), (end,))
                for p in parts:
                    rest += p
                    while len(rest) > 4 * capacity or (p is end and rest):
                        one = bytes(rest[:4 * capacity])
                        del rest[:4 * capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(done)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        data.append(one)
                        n += 1
                        done += len(one) // 4
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id, "piece", "start", "length", "ids_crc32"]
            if ids:
                cols.append(pa.array([np.frombuffer(d, "<i4") for d in data], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)


def _patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations [(size index, how many)] and how often each is used, until all counts are met.

    The fullest sequence over the sizes left is found by a knapsack over reachable
    fills; sizes with the most left to place are tried first.
    """
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        take: list[np.ndarray] = []
        reach = np.zeros(capacity + 1, dtype=bool)
        reach[0] = True
        # larger sizes first: the pattern found holds the large sizes that are hardest to place
        order = [int(i) for i in np.argsort(-sizes, kind="stable") if left[i]]
        first = order[0]
        base = int(sizes[first])
        used = []
        for i in order:
            before = reach.copy()
            s = int(sizes[i])
            most = min(int(left[i]) - (i == first), (capacity - base) // s)
            room = reach
            for _ in range(most):
                grown = room.copy()
                grown[s:] |= room[:-s]
                if (grown == room).all():
                    break
                room = grown
            reach = room
            take.append(before)
            used.append(i)
            if reach[capacity - base]:
                break
        fill = int(np.flatnonzero(reach[:capacity - base + 1])[-1])
        chosen: dict[int, int] = {first: 1}
        for before, i in zip(reversed(take), reversed(used)):
            s = int(sizes[i])
            while not before[fill]:
                fill -= s
                chosen[i] = chosen.get(i, 0) + 1
        times = min(int(left[i]) // n for i, n in chosen.items())
        for i, n in chosen.items():
            left[i] -= n * times
        out.append((sorted(chosen.items()), times))
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int | None = None, weak: float = WEAK) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece; lengths are from 1 to ``capacity``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    seq, off = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return seq, off
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    seq[full] = np.arange(len(full))
    order = order[len(full):]
    large = order[lengths[order] > capacity * LARGE_SHARE]
    rest = order[len(large):].tolist()
    fills: list[int] = []
    base = len(full)
    if len(large):
        # equal cardinality: the k-th group of the lengths in falling order, rounded up to its largest
        group = np.arange(len(large)) * (groups or -(-len(large) // GROUP_PIECES)) // len(large)
        at = np.searchsorted(group, np.arange(group[-1] + 2))
        at = at[np.append(True, np.diff(at) > 0)]
        rounded = lengths[large[at[:-1]]]
        sizes, which = np.unique(rounded, return_inverse=True)
        members = [[] for _ in sizes]
        for g in range(len(rounded)):
            members[which[g]].extend(large[at[g]:at[g + 1]].tolist())
        counts = np.array([len(m) for m in members])
        heads = [0] * len(sizes)
        opened: list[int] = []
        for chosen, times in _patterns(sizes, counts, capacity):
            for _ in range(times):
                here, own = 0, []
                for i, k in chosen:
                    own += members[i][heads[i]:heads[i] + k]
                    heads[i] += k
                if int(lengths[own].sum()) < weak * capacity:
                    opened += own
                    continue
                for p in own:
                    seq[p], off[p] = base + len(fills), here
                    here += int(lengths[p])
                fills.append(here)
        rest = sorted(opened, key=lambda p: (-lengths[p], p)) + rest
    # best fit: the sequence with the least room that is enough; opened sequences join in
    rooms: dict[int, list[int]] = {}
    for b, f in enumerate(fills):
        rooms.setdefault(capacity - f, []).append(b)
    keys = sorted(rooms)
    for p in rest:
        size = int(lengths[p])
        i = bisect.bisect_left(keys, size)
        if i == len(keys):
            fills.append(0)
            b, room = len(fills) - 1, capacity
        else:
            room = keys[i]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], keys[i]
        seq[p], off[p] = base + b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            if left not in rooms:
                bisect.insort(keys, left)
                rooms[left] = []
            rooms[left].append(b)
    return seq, off


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, id: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (columns piece, start, length, ids_crc32).

    The shard count follows from the number of pieces, and a piece's shard from its
    place in the stored frame, so that repeated rows spread too; a shard's pieces are
    sorted in the task, so a lost executor repeats the same numbers. ``pieces`` is
    read twice: give it a stored or checkpointed frame.
    """
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(id, "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        seq, off = pack(table["length"].to_numpy(), capacity)
        shard = np.int64(table["shard"][0].as_py())
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq * shards + shard)).append_column("offset", pa.array(off))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.withColumn("shard", key).groupBy("shard").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All documents as packed pieces. The pieces' numbers (not their texts) are checkpointed once."""
    return pack_pieces(piece_documents(docs, tokenizer_path, capacity, text=text, id=id).checkpoint(), capacity, id=id)
