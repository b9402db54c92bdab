"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (words and word beginnings that mark
toxic documents, learned from the labelled sample), how near its hits stand to
second-person words, capitals, punctuation, and how often letters are mixed with digits or
symbols, also inside lexicon words. Trees are fitted by Spark ML, their margin is mapped
to a probability by isotonic regression on labelled rows that the trees have not seen.

Labels are learned only from rows whose crc32(id as text) mod 5 is not 0 (fold 0 is held
out; fold 4 calibrates), and of these from at most ``SAMPLE``, those with the smallest
id hashes. The sample's ids are broadcast, its texts are stored once, and all learning
reads that store. Every word and word beginning of the sample is counted; the model keeps
the ``LEXICON`` best. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has all features 0 and is scored like any other; a
null id is never held out; several labels of an id: the largest counts; with labels of one
kind only, every score is that kind; repeated rows score alike; an empty table gives no
rows; extra columns pass through ``keep_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vecflow.llm.common import as_bytes, concat_texts, hashed_texts, mix64, text_slices

#: labelled rows used, at most
SAMPLE = 20_000
#: entries of the lexicon: the model's size
LEXICON = 2_000
#: distinct entries that a counting task holds before it hands them on
HELD = 200_000
#: partitions of the stored sample
PARTS = 32
#: classes of copies that an entry must occur in, among the toxic rows
OFTEN = 4
#: smallest hashes of a text's runs of SHINGLE words that find its copies, and how many of them copies share
SKETCH, SHINGLE, ALIKE = 8, 4, 4
#: lengths of word beginnings that may be entries
STEMS = (4, 5, 6)
#: a hit is near a second-person word within so many words
NEAR = 5
CACHE_ENTRIES = 400_000

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre "
                          "vos usted ustedes ti tuyo tus vosotros os".split())
# Characters that stand for letters.
LOOKALIKE = str.maketrans("013457@$!|€", "oieastasile")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»’‘…–—"
FEATURES = ("hits_per_word", "weight_per_word", "log_hits", "distinct_hits", "heaviest", "hits_near_you", "you_per_word", "capitals",
            "capital_words", "punctuation", "exclamations", "symbols", "mixed_words", "mixed_hits", "log_words")


def entries_of(word: str) -> set[str]:
    """A word and its beginnings, as they may stand in the lexicon (beginnings end in ``*``)."""
    return {word, *(word[:n] + "*" for n in STEMS if len(word) >= n)}


def plain_word(chunk: str) -> tuple[str, bool]:
    """(word, mixed) of a lower-cased chunk: edges stripped, look-alikes read as letters."""
    word = chunk.strip(_EDGE)
    if word.isalpha() or not word:
        return word, False
    bare = word.replace("'", "").replace("’", "").replace("-", "")
    mixed = not bare.isalpha() and any(c.isalpha() for c in bare) and len(bare) > 2
    if not mixed:
        return word, False
    # symbols at the chunk's edges may stand for letters as well
    return "".join(c for c in chunk.translate(LOOKALIKE) if c.isalpha()), True


class WordMarks(dict):
    """What a chunk means for the features: None for a plain word, else (weight, second person, mixed, entry)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str):
        word, mixed = plain_word(chunk)
        weight, entry = max(((self.lexicon.get(e, 0.0), e) for e in entries_of(word)), default=(0.0, ""))
        you = word in SECOND_PERSON
        mark = (weight, you, mixed, entry) if weight or you or mixed else None
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(chunk) <= 48:
            self[chunk] = mark
        return mark


def _byte_rates(texts: list[bytes]) -> np.ndarray:
    """Counts per text: letters, capitals, words in capitals, punctuation, exclamations, symbols."""
    out = np.zeros((len(texts), 6))
    for lo, hi in text_slices(texts):
        buf, offsets = concat_texts(texts[lo:hi])
        upper = (buf >= 65) & (buf <= 90)
        letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 192)
        punct = (buf > 32) & (buf < 127) & ~letter & ~((buf >= 48) & (buf <= 57))
        pair = np.zeros(len(buf), dtype=bool)
        pair[1:] = upper[1:] & upper[:-1]
        loud = (buf == 33) | (buf == 63)
        symbol = punct & ~np.isin(buf, np.frombuffer(b".,;:'\"-!?()", dtype=np.uint8))
        for k, mask in enumerate((letter, upper, pair, punct, loud, symbol)):
            run = np.zeros(len(buf) + 1, dtype=np.int64)
            np.cumsum(mask, out=run[1:])
            out[lo:hi, k] = run[offsets[1:]] - run[offsets[:-1]]
    return out


def features(texts: list[bytes], marks: WordMarks) -> np.ndarray:
    counts = _byte_rates(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for row, t in enumerate(texts):
        chunks = t.decode().lower().split()
        n = len(chunks)
        if not n:
            continue
        marked = [(i, m) for i, c in enumerate(chunks) if (m := marks[c])]
        hits = [(i, m) for i, m in marked if m[0]]
        you = np.array([i for i, m in marked if m[1]])
        at = np.array([i for i, _ in hits])
        near = 0
        if len(you) and len(at):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        letters, size = max(counts[row, 0], 1.0), max(len(t), 1)
        out[row] = (len(hits) / n, sum(m[0] for _, m in hits) / n, math.log1p(len(hits)), len({m[3] for _, m in hits}),
                    max((m[0] for _, m in hits), default=0.0), near, len(you) / n, counts[row, 1] / letters, counts[row, 2] / letters,
                    counts[row, 3] / size, counts[row, 4] / n, counts[row, 5] / n, sum(m[2] for _, m in marked) / n,
                    sum(m[2] for _, m in hits), math.log1p(n))
    return out


def sample_labels(labels: DataFrame, id: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc, toxic, fold) of at most ``sample`` labelled ids outside fold 0."""
    rows = labels.where(F.col(id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(id).alias("doc")).agg(
        F.max(F.col(toxic).cast("int")).alias("toxic")).withColumn("fold", fold(F.col("doc"))).where("fold != 0")
    return rows.orderBy(F.xxhash64("doc"), "doc").limit(sample)


def fold(id):
    return (F.crc32(id.cast("string").cast("binary")) % 5).cast("int")


def sketches(texts: list[bytes]) -> np.ndarray:
    """SKETCH smallest hashes, each of its own order, of every text's runs of SHINGLE words."""
    out = np.zeros((len(texts), SKETCH), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row, h in hashed_texts(texts):
            run = h if len(h) < SHINGLE else np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
            if len(h) >= SHINGLE:
                for k in range(SHINGLE):
                    run = mix64(run + h[k:len(h) - SHINGLE + 1 + k])
            if len(run):
                out[row] = [mix64(run + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)).min() for k in range(SKETCH)]
    return out


def copy_classes(found: np.ndarray) -> np.ndarray:
    """Class of copies of each row of sketches: rows that share ALIKE hashes with the first row that has one of them."""
    up = np.arange(len(found))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k in range(SKETCH):
        _, first, back = np.unique(found[:, k], return_index=True, return_inverse=True)
        leader = first[back]
        for i in np.flatnonzero((leader != np.arange(len(found))) & ((found == found[leader]).sum(axis=1) >= ALIKE)):
            up[top(i)] = top(leader[i])
    return np.array([top(i) for i in range(len(found))], dtype=np.int64)


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Entries with their log odds, from (text, toxic): counts of classes of copies among toxic rows first, then of the other documents."""
    def sketch(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in sketches(as_bytes(b.column(0))).T], names=[f"s{k}" for k in range(SKETCH)])

    def by_class(classes):
        def run(batches):
            seen: set[tuple[str, int]] = set()

            def flush():
                return pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64())], names=["e", "c"])

            for b in batches:
                for t, key in zip(b.column(0).to_pylist(), sketches(as_bytes(b.column(0)))):
                    c = classes.value[key.tobytes()]
                    seen.update((e, c) for w in set((t or "").lower().split()) for e in entries_of(plain_word(w)[0]))
                    if len(seen) >= HELD:
                        yield flush()
                        seen.clear()
            yield flush()
        return run

    def count(batches):
        seen: Counter[str] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["e", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update({e for c in set((t or "").lower().split()) for e in entries_of(plain_word(c)[0])})
                if len(seen) >= HELD:
                    yield flush()
                    seen.clear()
        yield flush()

    n_toxic, n = rows.agg(F.sum("toxic"), F.count("toxic")).first()
    if not n_toxic or n_toxic == n:
        return {}
    toxic = rows.where("toxic = 1").select("text")
    order = [f"s{k}" for k in range(SKETCH)]
    known = toxic.mapInArrow(sketch, ", ".join(f"{c} long" for c in order)).distinct().orderBy(*order).collect()  # SAMPLE bounds them
    found = np.array([tuple(r) for r in known], dtype=np.int64).astype(np.uint64)
    classes = copy_classes(found)
    n_classes = len(np.unique(classes))
    held = rows.sparkSession.sparkContext.broadcast({x.tobytes(): int(c) for x, c in zip(found, classes)})
    bad = toxic.mapInArrow(by_class(held), "e string, c long").distinct().groupBy("e").agg(F.count(F.lit(1)).alias("k")).where(
        (F.col("k") >= OFTEN) & (F.length("e") > 1))
    good = rows.where("toxic = 0").select("text").mapInArrow(count, "e string, n long").groupBy("e").agg(F.sum("n").alias("n"))
    odds = F.log((F.col("k") + 0.5) / (n_classes + 1)) - F.log((F.coalesce("n", F.lit(0)) + 0.5) / (n - n_toxic + 1))
    best = bad.join(good, "e", "left").select("e", "k", odds.alias("odds")).where("odds > 3").orderBy(F.desc(F.col("odds") * F.col("k")), "e").limit(size)
    return {r.e: r.odds for r in best.collect()}


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` where the labels are of one kind only."""

    def __init__(self, lexicon=None, trees=None, isotonic=None, constant: float | None = None):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon or {}, trees, isotonic, constant

    def scored(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with the score in column ``out``; other columns as they are. No shuffle."""
        if self.constant is not None:
            return df.withColumn(out, F.lit(float(self.constant)))
        f, p, r = (f"{out}__{x}" for x in "fpr")
        rich = with_features(df, self.lexicon, text, f)
        rich = rich.withColumn(f, array_to_vector(F.col(f)))
        trees = self.trees.copy().setFeaturesCol(f).setPredictionCol(f"{out}__c").setProbabilityCol(p).setRawPredictionCol(r)
        rich = trees.transform(rich).withColumn(r, vector_to_array(F.col(r))[1])
        rich = self.isotonic.copy().setFeaturesCol(r).setPredictionCol(out).transform(rich)
        return rich.drop(f, p, r, f"{out}__c").withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)))


def with_features(df: DataFrame, lexicon: dict[str, float], text: str, out: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(lexicon)
    at = df.columns.index(text)

    def run(batches):
        marks = WordMarks(held.value)
        for b in batches:
            x = features(as_bytes(b.column(at)), marks)
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> ToxicityModel:
    known = sample_labels(labels, id).checkpoint()
    # one pass over the documents; what is learned reads the stored sample (dealt by id: copies spread)
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(known), "doc").repartition(PARTS, "doc").select(
        "text", "toxic", "fold").checkpoint()
    kinds = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return ToxicityModel(constant=float(next(iter(kinds), 0)))
    lexicon = learn_lexicon(rows)
    x = with_features(rows, lexicon, "text", "x").select(array_to_vector(F.col("x")).alias("features"), F.col("toxic").cast("double").alias("label"), "fold")
    # the trees pass over the stored features many times: a few tasks for at most SAMPLE short rows
    x = x.checkpoint().coalesce(8)
    fit, rest = x.where("fold != 4"), x.where("fold = 4")
    if fit.select("label").distinct().count() < 2:
        return ToxicityModel(constant=float(kinds.get(1, 0) >= kinds.get(0, 0)))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, maxBins=32).fit(fit)
    if rest.select("label").distinct().count() < 2:
        rest = fit
    margin = trees.transform(rest).select(vector_to_array("rawPrediction")[1].alias("margin"), "label")
    return ToxicityModel(lexicon, trees, IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin))


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = learn(docs, labels, text, id)
    return model.scored(docs.select(F.col(id), F.col(text)), text, "score").select(
        F.col(id), F.coalesce(fold(F.col(id)) == 0, F.lit(False)).alias("held_out"), F.col("score"),
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, all columns as they are."""
    out = "toxicity_score"
    while any(c.startswith(out) for c in docs.columns):
        out += "_"
    return model.scored(docs, text, out).where(F.col(out) < limit).select(*(F.col(f"`{c}`") for c in docs.columns))
