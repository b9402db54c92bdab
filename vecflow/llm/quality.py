"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good)
and one of the raw text (all documents), give every document a log importance weight: the
sum over its n-grams of log(target / raw). Documents are resampled without replacement by
Gumbel top-k: the k largest of weight plus Gumbel noise, the noise a function of id and
text, so that it can be computed again anywhere.

N-grams are token unigrams and bigrams (letters and digits, or a run of punctuation; A-Z
lower-cased) and trigrams of token shapes (case, digits, the punctuation itself, whether
the token repeats one of the two before it). k is the number of documents whose weight
reaches the threshold that separates labelled good from labelled bad best (balanced
accuracy, on labelled rows that the target model has not seen).

The labelled rows come from a bounded sample (``SAMPLE``, smallest id hashes); raw counts
cover every document. Models have a fixed size. The k-th largest key is found by counting
in ever finer bins, so nothing is sorted or gathered.

Defined cases: a null or empty text has weight 0; rows that tie with the k-th are kept;
repeated rows have equal weights; a null id is a value like any other; without both kinds
of labelled rows every document is kept; an empty table gives no rows; extra columns pass
through ``keep_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import as_bytes, concat_texts, hash_words, mix64, summed_blocks, text_slices

#: labelled rows used, at most
SAMPLE = 20_000
#: cells of each of the three hashed n-gram tables
CELL_BITS = 15
TABLES = 3
CELLS = TABLES << CELL_BITS
#: bins per counting step, and the largest bin whose keys are listed
BINS = 2048
LISTED = 10_000

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 letters, digits and non-ASCII, 2 punctuation
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def token_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and kinds of tokens, and the index of each text's first token (n + 1 values)."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, np.zeros(len(offsets), dtype=np.int64)
    kind = _KIND[buf]
    edge = np.ones(len(buf), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(buf)]] = True
    at = np.flatnonzero(edge)
    length = np.diff(np.append(at, len(buf)))
    keep = kind[at] != 0
    starts = at[keep]
    return starts, length[keep], kind[starts], np.searchsorted(starts, offsets)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, first): the three cells of each token, and the index of each text's first token."""
    starts, lengths, kind, first = token_spans(buf, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, TABLES), dtype=np.int64), first
    word = hash_words(buf, starts, lengths)
    # letters A-Z and digits of each token
    upper = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
    digit = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf >= 48) & (buf <= 57), out=digit[1:])
    ends = starts + lengths
    ups, digits = upper[ends] - upper[starts], digit[ends] - digit[starts]
    head = buf[starts]
    shape = np.where((ups >= 2) & (2 * ups >= lengths), 1, np.where((head >= 65) & (head <= 90), 2, 0))
    shape = np.where(digits > 0, 3, shape)
    shape = np.where(kind == 2, 16 + (word % np.uint64(1 << 20)).astype(np.int64), shape)
    nth = np.arange(n) - np.repeat(first[:-1], np.diff(first))  # place within the text
    one, two = np.roll(word, 1), np.roll(word, 2)
    again = (kind == 1) & (((nth >= 1) & (word == one)) | ((nth >= 2) & (word == two)))
    shape = shape + 8 * again
    gone = np.uint64(0)
    prev = np.where(nth >= 1, one, gone)
    s0 = mix64(shape.astype(np.uint64) + np.uint64(1))
    s1 = np.where(nth >= 1, np.roll(s0, 1), gone)
    s2 = np.where(nth >= 2, np.roll(s0, 2), gone)
    k3, k5 = np.uint64(3), np.uint64(5)
    down = np.uint64(64 - CELL_BITS)
    cells = np.empty((n, TABLES), dtype=np.int64)
    cells[:, 0] = word >> down
    cells[:, 1] = mix64(word + k3 * prev) >> down
    cells[:, 2] = mix64(s0 + k3 * s1 + k5 * s2) >> down
    cells += np.arange(TABLES) << CELL_BITS
    return cells, first


@dataclass(frozen=True)
class Model:
    """log(target / raw) of every cell, and what a document's key must reach to be kept."""

    ratio: np.ndarray
    cut: float = -np.inf


def labelled(labels: DataFrame, id: str = "doc_id", quality: str = "quality", sample: int = SAMPLE) -> dict:
    """{id: (quality, fold)} of at most ``sample`` labelled ids; several labels of an id: the lowest."""
    rows = labels.where(F.col(quality).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("doc")).agg(
        F.min(quality).alias("q")).withColumn("h", F.xxhash64("doc")).orderBy("h", "doc").limit(sample)
    return {r.doc: (int(r.q), r.h % 5) for r in rows.collect()}


def learn(docs: DataFrame, known: dict, text: str = "text", id: str = "doc_id") -> Model:
    """Target and raw counts in one pass over all documents; the target model leaves out fold 0."""
    target = docs.sparkSession.sparkContext.broadcast(frozenset(d for d, (q, fold) in known.items() if q == 1 and fold))

    def count(batches):
        acc = np.zeros(2 * CELLS, dtype=np.int64)
        for b in batches:
            texts, good = as_bytes(b.column(1)), [d in target.value for d in b.column(0).to_pylist()]
            for lo, hi in text_slices(texts):
                cells, first = features(*concat_texts(texts[lo:hi]))
                acc[:CELLS] += np.bincount(cells.ravel(), minlength=CELLS)
                chosen = np.repeat(np.array(good[lo:hi], dtype=bool), np.diff(first))
                if chosen.any():
                    acc[CELLS:] += np.bincount(cells[chosen].ravel(), minlength=CELLS)
        return acc

    total = summed_blocks(docs.select(F.col(id), F.col(text)), count, 2 * CELLS)
    raw, good = total[:CELLS].reshape(TABLES, -1) + 1.0, total[CELLS:].reshape(TABLES, -1)
    raw /= raw.sum(axis=1, keepdims=True)
    if not good.any():
        return Model(np.zeros(CELLS))
    # as many pseudo-counts as cells, spread as the raw text is
    size = raw.shape[1]
    aim = (good + size * raw) / (good.sum(axis=1, keepdims=True) + size)
    return Model(np.log(aim / raw).ravel())


def weights(texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log importance weight, tokens) of each text."""
    out, tokens = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for lo, hi in text_slices(texts):
        cells, first = features(*concat_texts(texts[lo:hi]))
        run = np.zeros(len(cells) + 1)
        np.cumsum(ratio[cells].sum(axis=1), out=run[1:])
        out[lo:hi] = run[first[1:]] - run[first[:-1]]
        tokens[lo:hi] = np.diff(first)
    return out, tokens


def gumbel(ids: list, texts: list[bytes]) -> np.ndarray:
    u = np.array([xxhash.xxh64_intdigest(str(i).encode() + b"\0" + t) for i, t in zip(ids, texts)], dtype=np.float64)
    return -np.log(np.maximum(-np.log((u + 0.5) / 2.0**64), 1e-18))


def score_documents(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, log_weight, resampling_key) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            w, tokens = weights(texts, held.value.ratio)
            key = w + gumbel(b.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens), pa.array(w), pa.array(key)],
                                             names=[id, "n_tokens", "log_weight", "resampling_key"])

    return docs.select(F.col(id), F.col(text)).mapInArrow(
        run, f"`{id}` {kind}, n_tokens long, log_weight double, resampling_key double")


def threshold(scored: DataFrame, known: dict, id: str = "doc_id") -> float:
    """The weight that separates labelled good from bad best, on fold 0 of the bounded sample."""
    held = {d: q for d, (q, fold) in known.items() if not fold}
    if len(set(held.values())) < 2:
        return -np.inf
    spark = scored.sparkSession
    kind = scored.schema[id].dataType.simpleString()
    some = spark.createDataFrame([(d, q) for d, q in held.items()], f"`{id}` {kind}, q int")
    rows = scored.join(F.broadcast(some), id).groupBy(id).agg(F.min("log_weight").alias("w"), F.first("q").alias("q")).select("w", "q").collect()
    if len({r.q for r in rows}) < 2:
        return -np.inf
    w, q = np.array([r.w for r in rows]), np.array([r.q for r in rows]) == 1
    order = np.argsort(w, kind="stable")
    w, q = w[order], q[order]
    # cutting below row i rejects the rows before it
    right = np.append(0, np.cumsum(~q)) / (~q).sum() + (q.sum() - np.append(0, np.cumsum(q))) / q.sum()
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate([[w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def kth_largest(values: DataFrame, k: int, column: str) -> float:
    """The k-th largest of a column, exactly: counts in bins, then in bins of the bin that holds it."""
    if k <= 0:
        return np.inf
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -np.inf
    inside, above = values.select(F.col(column).alias("x")), 0
    while True:
        part = inside.where((F.col("x") >= lo) & (F.col("x") <= hi))
        step = (hi - lo) / BINS
        if step <= 0 or not lo + step > lo:
            return float(lo)
        bin = F.least(F.floor((F.col("x") - lo) / step), F.lit(BINS - 1))
        rows = sorted(part.groupBy(bin.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(),
                      key=lambda r: -r.b)
        for r in rows:
            if above + r.n >= k:
                break
            above += r.n
        lo, hi = r.lo, r.hi
        if lo == hi:
            return float(lo)
        if r.n <= LISTED:
            listed = sorted((x.x for x in inside.where((F.col("x") >= lo) & (F.col("x") <= hi)).collect()), reverse=True)
            return float(listed[k - above - 1])


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, Model]:
    """(scores with the decision ``kept``, the model with its cut)."""
    known = labelled(labels, id)
    model = learn(docs, known, text, id)
    scored = score_documents(docs, model, text, id).checkpoint()
    low = threshold(scored, known, id)
    k = scored.where(F.col("log_weight") >= F.lit(low)).count()
    model = Model(model.ratio, kth_largest(scored, k, "resampling_key"))
    return scored.withColumn("kept", F.col("resampling_key") >= F.lit(model.cut)), model


def keep_documents(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents that the model's cut keeps, all columns as they are; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(id), docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(at[1]))
            w, _ = weights(texts, held.value.ratio)
            key = w + gumbel(b.column(at[0]).to_pylist(), texts)
            yield b.filter(pc.greater_equal(pa.array(key), held.value.cut))

    return docs.mapInArrow(run, docs.schema)
