"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed into dictionary phrases (a phrase is the shortest prefix of the
rest that the dictionary does not hold, and then joins it); the phrase set is hashed
and its ``k`` smallest hashes are the signature, so that equal shares of equal
signatures estimate the Jaccard likeness of the phrase sets, a compression-like
similarity. A text edited near its end shares the parse of everything before the
edit, and that part is parsed once for both.

Neighbours in doc_id order meet without a global sort: texts go once through a
shuffle into ranges of doc_id, each range sorted and streamed, and the first text of
every range is sent to the range before it as well (after the last: to the first).

Defined cases: a null text is the empty text; two texts without phrases are alike
(1.0), one without and one with are not (0.0); a null doc_id sorts first; rows with
equal doc_id are ordered by their text; a table of one row has itself as its next
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import _powers, input_partitions, mix64

#: hashes kept of a document's phrases
SIGNATURE = 128
#: ranges of doc_id per partition; several even out the partitions' sizes
RANGES = 4
#: documents per range at most, about
RANGE_DOCS = 20_000
#: ranges at most: the driver holds two numbers of each; larger ranges sort on disk
MAX_RANGES = 10_000


def parse(text: str, start: int, seen: set[str], found: list[str]) -> list[int]:
    """Phrases of ``text[start:]`` given the dictionary ``seen``: adds them to it and to ``found``; their ends."""
    ends: list[int] = []
    i, n = start, len(text)
    add, keep, note = seen.add, found.append, ends.append
    while i < n:
        j = i + 2
        w = text[i:j]
        if w in seen:
            j += 1
            w = text[i:j]
            while w in seen and j < n:
                j += 1
                w = text[i:j]
        elif text[i] not in seen:  # the dictionary holds every prefix of what it holds
            j = i + 1
            w = text[i]
        add(w)
        keep(w)
        note(j if j < n else n)
        i = j
    return ends


def phrase_hashes(text: str, bounds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the phrases between neighbouring bounds; depend on their characters only."""
    if len(bounds) < 2:
        return np.zeros(0, dtype=np.uint64)
    chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    length = np.diff(bounds)
    pos = np.arange(len(chars), dtype=np.int64) - np.repeat(bounds[:-1], length)
    h = np.add.reduceat(chars * _powers(int(length.max()))[pos], bounds[:-1])
    return mix64(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(hashes: np.ndarray, k: int = SIGNATURE) -> np.ndarray:
    """The upper halves of the k smallest distinct hashes, rising."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:k]


def text_form(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def from_text_form(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Share of the k smallest hashes of both together that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:k]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, low[-1], side="right") / len(low))


def fingerprint(text: str | None, k: int = SIGNATURE) -> np.ndarray:
    text = text or ""
    ends = parse(text, 0, set(), [])
    return signature(phrase_hashes(text, np.array([0, *ends])), k)


def both_fingerprints(text: str, edited: str, common: int, k: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and of one that agrees with it in the first ``common`` characters.

    Phrases that end within the common part are the same for both and parsed once.
    """
    known: list[str] = []
    bounds = np.array([0, *parse(text, 0, set(), known)])
    h = phrase_hashes(text, bounds)
    own = signature(h, k)
    if edited == text:
        return own, own
    kept = int(np.searchsorted(bounds, common, side="right")) - 1
    lo = int(bounds[kept])
    more = parse(edited, lo, set(known[:kept]), [])
    tail = phrase_hashes(edited[lo:], np.array([lo, *more]) - lo)
    return own, signature(np.concatenate([h[:kept], tail]), k)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many of the next document."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut] if cut else text


COLUMNS = ("`{id}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _row(doc, text: str, following: str, k: int) -> list:
    edited = edited_text(text, following)
    own, other = both_fingerprints(text, edited, len(text) - len(text) // 4, k)
    return [doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other]


def _finished(row: list, following: np.ndarray, k: int) -> tuple:
    doc, n, sha, own, other = row
    return doc, n, sha, text_form(own), text_form(other), likeness(own, other, k), likeness(own, following, k)


def edit_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = SIGNATURE) -> DataFrame:
    """Per document: size, SHA-256 of the edited text, both fingerprints, likeness to the edited and to the next text."""
    spark = docs.sparkSession
    keys = docs.select(F.col(id).cast("long").alias("doc"))
    total = keys.count()
    parts = input_partitions(spark)
    ranges = min(max(parts * RANGES, -(-total // RANGE_DOCS)), MAX_RANGES)
    # any bounds give the same result; these are a summary of bounded size
    cuts = keys.approxQuantile("doc", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if total else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def range_of(column: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")

    def lowest(batches):
        low: dict[int, int | None] = {}
        for b in batches:
            for r, d in zip(range_of(b.column(0)).tolist(), b.column(0).to_pylist()):
                if r not in low or (low[r] is not None and (d is None or d < low[r])):
                    low[r] = d
        yield pa.RecordBatch.from_pydict({"r": pa.array(list(low), pa.int32()), "d": pa.array(list(low.values()), pa.int64())})

    # one row per range: its smallest doc id, null smallest
    lows = keys.mapInArrow(lowest, "r int, d long").groupBy("r").agg(
        F.min("d").alias("d"), F.max(F.col("d").isNull()).alias("none")).orderBy("r").collect()
    first = [(r.r, None if r.none else r.d) for r in lows]
    sent_to = {doc: first[i - 1][0] for i, (_, doc) in enumerate(first)}

    def deal(batches):
        for b in batches:
            r = range_of(b.column(0)).tolist()
            extra = [i for i, d in enumerate(b.column(0).to_pylist()) if d in sent_to]
            take = pa.array([*range(len(r)), *extra], pa.int64())
            ids = b.column(0).take(take)
            halo = [0] * len(r) + [1] * len(extra)
            to = r + [sent_to[d] for d in ids.to_pylist()[len(r):]]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(halo, pa.int32()), ids, b.column(1).take(take)],
                                             names=["r", "halo", "doc", "text"])

    def scan(batches):
        waiting = text_now = doc_now = None  # waiting: all but its likeness to the next
        done: list[tuple] = []
        over = None  # the range whose last document is finished
        for b in batches:
            for r, halo, doc, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t or ""
                if halo and r == over:
                    continue
                if text_now is not None:
                    row = _row(doc_now, text_now, t, k)
                    if waiting:
                        done.append(_finished(waiting, row[3], k))
                    waiting = row
                if halo:
                    done.append(_finished(waiting, fingerprint(t, k), k))
                    waiting = text_now = doc_now = None
                    over = r
                else:
                    doc_now, text_now = doc, t
            yield _batch(done)
            done = []

    kind = docs.schema[id].dataType.simpleString()
    dealt = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        deal, "r int, halo int, doc long, text string")
    out = dealt.repartition(parts, "r").sortWithinPartitions("r", "halo", "doc", "text").mapInArrow(
        scan, COLUMNS.format(id=id, kind="long"))
    return out.withColumn(id, F.col(id).cast(kind))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
