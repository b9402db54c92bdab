"""Quality, toxicity and language model: formulas by brute force, models by held-out accuracy."""

import bisect
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from helpers import DOCS, odd_rows
from vecflow.llm import common, quality, toxicity
from vecflow.llm import language_model as lm

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # sf0.01 has six held-out toxic documents
LABELS = "doc_id long, quality int, toxic int"


# ------------------------------------------------------------------ language model
def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def expected_base(rows):
    counts = collections.Counter()
    for i, t in rows:
        if not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    whole = math.log10(n + 0.5 * (v + 1))
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10(counts[w] + 0.5) - whole for w in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_counts_and_base_scores(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)  # the joined way must give what the broadcast one gives
    rows = odd_rows()
    got = sorted((tuple(r) for r in lm.score_documents(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    want = sorted(expected_base([r[:2] for r in rows]), key=repr)
    key = lambda r: (repr(r[0]), r[-1])
    flat = sorted(((g[0], g[2], g[3], g[4], g[5]) for g in got), key=key)
    for g, w in zip(flat, sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
    assert len(flat) == len(want) and all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_model_is_a_distribution():
    """Over all words and one unseen word of each group, the shares of a history sum to one."""
    rng = np.random.default_rng(0)
    w = rng.standard_normal((lm.CELLS, lm.CLASSES)).astype(np.float32) * 0.1
    rows, prior = rng.integers(0, lm.CELLS, (50, 4)), np.zeros(lm.CLASSES, np.float32)
    assert np.allclose(sum(np.exp(lm.log_shares(w, rows, np.full(50, c), prior)) for c in range(lm.CLASSES)), 1, atol=1e-5)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_sums_over_a_batch(few, monkeypatch):
    monkeypatch.setattr(lm, "FEW", few)
    rng = np.random.default_rng(4)
    rows = np.minimum(rng.geometric(0.02, (500, 3)), 200).astype(np.int64)  # cells met once to some hundred times
    d = rng.standard_normal((500, lm.CLASSES)).astype(np.float32)
    want = np.zeros((201, lm.CLASSES))
    np.add.at(want, rows, d[:, None])
    used, g = lm._sums(rows, d)
    assert sorted(used) == sorted(set(rows.ravel().tolist())) and np.allclose(g, want[used], atol=1e-4)
    assert lm._sums(rows[:0], d[:0])[1].shape == (0, lm.CLASSES)


def test_products_are_the_sums_scores():
    """Exponentials multiplied per history give what exponentials of sums do; where a sum might be bounded, there are none."""
    rng = np.random.default_rng(6)
    w = rng.standard_normal((lm.CELLS, lm.CLASSES)).astype(np.float32)
    prior = np.log(rng.dirichlet(np.ones(lm.CLASSES))).astype(np.float32)
    rows, cls = rng.integers(0, lm.CELLS - 1, (lm.BATCH + 7, 4)), rng.integers(0, lm.CLASSES, lm.BATCH + 7)
    factors = lm.factors_of(w[:-1], 4, prior + w[-1])
    assert np.allclose(lm.class_shares(w, rows, cls, prior, factors), lm.class_shares(w, rows, cls, prior), atol=1e-4)
    nodes = np.log(rng.dirichlet(np.ones(lm.WAYS), 70)).astype(np.float32)
    classes = lm.Classes(1, 1, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int64), np.zeros(32), prior, shares=nodes)
    part = np.sort(rng.integers(0, 900, len(rows))), rng.integers(0, 70, len(rows)), cls, rows[:, :2]
    assert np.allclose(lm.step_shares(w, 900, part, classes, lm.factors_of(w, 2, nodes)), lm.step_shares(w, 900, part, classes), atol=1e-3)
    assert lm.factors_of(w * 20, 4, prior) is None


def test_batches_share_their_arrays():
    """A batch's sums lie where the batch before had its own: fresh arrays cost more than the sums."""
    rows, d = np.arange(64).reshape(32, 2), np.ones((32, lm.CLASSES), np.float32)
    assert np.shares_memory(lm._sums(rows, d)[1], lm._sums(rows, d)[1])


def test_frequent_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(7)
    crowd = (np.uint64(5) << np.uint64(44)) + np.arange(40, dtype=np.uint64) * np.uint64(3)  # one bucket
    hashes = np.sort(np.concatenate([crowd, rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 2], np.uint64)]))
    words = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    for held in (hashes, hashes[:1], hashes[:0]):
        at = lm.places_of(held, lm.buckets(held), words)
        got = held[at] == words if len(held) else np.zeros(len(words), bool)
        assert (got == np.isin(words, held)).all()


def test_words_hashes_are_sums_of_powers():
    texts = [b"The the " + b"Q" * 70_000 + b" x" * 40_000, b"", " \u00e9\u00df \u6f22".encode()]
    h, _, at = lm.words_of(texts)
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
    raw = []
    for w in words:
        total, power = 0, 1
        for b in w:
            total, power = total + (b + 1) * power, power * common._BASE % (1 << 64)
        raw.append((total + len(w) * int(common._GOLDEN)) % (1 << 64))
    assert at.tolist() == [0, 40_003, 40_003, 40_005] and (h == common.mix64(np.array(raw, np.uint64))).all()


def test_histories_do_not_cross_texts():
    words, endings, at = lm.words_of([b"a b c", b"", b"d E"])
    classes = lm.Classes(1, 1, 1, np.sort(words), np.ones(5, np.int64), np.full(1 << 16, 31), np.zeros(32), np.zeros(32, np.float32))
    cls, rows, first = lm.positions(words, endings, at, classes)
    assert first.tolist() == [0, 4, 5, 8] and [int(c == lm.END) for c in cls] == [0, 0, 0, 1, 1, 0, 0, 1]
    alone, _, _ = lm.words_of([b"d E"])
    same = lm.positions(*lm.words_of([b"d e"]), classes)[1]
    assert (rows[5:8] == same).all() and len(alone) == 2


def test_held_out_texts_score_better_than_base(spark):
    got = E.queries()["op5_maxent_scores"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]


def test_words_of_one_class_follow_their_history(spark):
    """"zaqo" and "zuqo" end alike and are equally frequent: only the history tells them apart."""
    rng = random.Random(3)
    singles = " ".join(f"c{k}" for k in range(lm.SINGLES)) + " "
    rows = [(i, singles * 20 + " ".join(rng.choice(["left zaqo", "right zuqo", f"x{rng.randrange(400)}qo"]) for _ in range(30))) for i in range(1000)]
    tests = [(-1, "left zaqo"), (-2, "left zuqo"), (-3, "right zuqo"), (-4, "right zaqo")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows + tests], DOCS)
    score = {r.doc_id: r.score for r in lm.score_documents(docs).where("doc_id < 0").collect()}
    assert score[-1] > score[-2] + 0.3 and score[-3] > score[-4] + 0.3


def test_shares_inside_a_class_sum_to_one(spark):
    """Known words and one unseen word spread over the leaves, whatever the parameters."""
    words, endings, _ = lm.words_of([" ".join(f"w{i}ab" for i in range(300)).encode()])
    counts = np.arange(1, 301)
    vocabulary = spark.createDataFrame([(int(h), int(e), int(n)) for h, e, n in zip(words.view(np.int64), endings, counts)], "h long, ending int, n long")
    classes = lm.summarise(vocabulary, 1)
    w = np.random.default_rng(0).standard_normal((classes.cells, lm.WAYS)).astype(np.float32)
    group = int(classes.ending[endings[0]])
    inside = classes.of(words, endings) == group
    bits = 5 * int(classes.depth[group])
    leaves = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def shares(last):
        """What the history (the word 'w7ab' before) adds to each of the words."""
        seq = np.stack([np.full(len(last), words[7]), last], axis=1).ravel()
        at = np.arange(len(last) + 1) * 2
        cls, _, first = lm.positions(seq, np.full(len(seq), endings[0]), at, classes)
        return lm.step_shares(w, len(cls), lm.steps(seq, at, cls, classes), classes)[first[:-1] + 1]

    assert classes.depth[group] == 3 and inside.sum() == 300 - lm.SINGLES
    known = ((counts[inside] + 0.5) * np.exp(shares(words[inside]))).sum()
    unseen = 0.5 / len(leaves) * np.exp(shares(leaves)).sum()
    assert (known + unseen) / 10 ** classes.scale[group] == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    """One file or seven, in either order, and any number of shuffle partitions."""
    docs = spark.createDataFrame([(i, f"the a{i % 7} of b{i % 5} and c{i}" * (1 + i % 3)) for i in range(60)], "doc_id long, text string")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for df, parts in ((docs.coalesce(1), "8"), (docs.orderBy(F.desc("doc_id")).repartition(7), "3")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: r.score for r in lm.score_documents(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(math.isclose(got[0][i], got[1][i], rel_tol=1e-4) for i in range(60))


def test_language_model_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    only = spark.createDataFrame([(2, "x y", "", 1, 1)], DOCS)  # crc32("2") mod 5 decides
    row = lm.score_documents(only).first()
    assert row.train_tokens == (0 if lm.held_out(2) else 3) and math.isfinite(row.score)


# ------------------------------------------------------------------ quality
def test_quality_on_labels(spark):
    got = E.queries()["op9_importance_resampling"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.1


def test_keeping_agrees_with_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored, model = quality.resample(docs, labels)
    kept = quality.keep_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("kept").collect()}


def test_weights_are_sums_over_texts():
    ratio = np.random.default_rng(1).standard_normal(quality.CELLS)
    texts = [(r[1] or "").encode() for r in odd_rows()]
    w, n = quality.weights(texts, ratio)
    for t, x, k in zip(texts, w, n):
        one, m = quality.weights([t], ratio)
        assert one[0] == pytest.approx(x, abs=1e-6) and m[0] == k
    assert w[0] == w[1] == 0 and n[1] == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    xs = [rng.choice([rng.gauss(0, 1e6), float(rng.randrange(5)), rng.random()]) for _ in range(30_000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    order = sorted(xs, reverse=True)
    for k in (1, 2, 9_999, 15_000, 29_999):
        assert quality.kth_largest(df, k, "x") == order[k - 1]
    assert quality.kth_largest(df, 0, "x") == math.inf and quality.kth_largest(df, 30_000, "x") == -math.inf


def test_quality_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    none = spark.createDataFrame([], LABELS)
    scored, model = quality.resample(df, none)
    assert scored.where("kept").count() == df.count() == quality.keep_documents(df, model).count()
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(None, 1, 1), (3, None, None), (3, 0, 1)], LABELS)
    assert quality.resample(df, some)[0].count() == df.count()
    assert quality.resample(spark.createDataFrame([], DOCS), some)[0].count() == 0


# ------------------------------------------------------------------ toxicity
def test_toxicity_on_held_out_labels(spark):
    got = E.queries()["op7_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("toxic", "predicted", "score").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.95 * len(rows)
    bad, good = (sorted(r.score for r in rows if r.toxic == t) for t in (1, 0))
    assert sum(bisect.bisect_left(good, b) for b in bad) > 0.97 * len(bad) * len(good)


def test_lexicon_counts_classes_of_copies(spark):
    """A word in four of 400 toxic documents is an entry; words of one document's many altered copies are none."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = text(80).split()
    rows = [(text(80) + (" zworp" if i < 4 else ""), 1) for i in range(360)]
    rows += [(" ".join(base[:i] + [f"q{i}"] + base[i + 1:]) + " copyword", 1) for i in range(40)]
    rows += [(text(80), 0) for _ in range(3000)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "zworp" in lexicon and "copyword" not in lexicon


def test_toxicity_recall_on_held_out_rows(spark):
    got = E.queries()["op7_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out AND toxic = 1")
    found, n = got.agg(F.sum("predicted"), F.count(F.lit(1))).first()
    assert found >= 0.85 * n


def test_folds_and_columns(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    labels = spark.createDataFrame([(i, 1, int(i in (5, 6, 7, 8))) for i in range(15)], LABELS)
    rows = toxicity.score_documents(df, labels).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_toxicity_without_both_labels(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score_documents(df, none).collect()} == {0.0}
    model = toxicity.learn(df, none)
    kept = toxicity.keep_documents(df, model)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).count() == 0


def test_mixed_words_are_read_as_letters():
    assert toxicity.plain_word("st*pid,")[1] and toxicity.plain_word("1d1ot!") == ("idioti", True)
    assert toxicity.plain_word("don't") == ("don't", False) and toxicity.plain_word("word,") == ("word", False)
    marks = toxicity.WordMarks({"idiot": 5.0})
    near = toxicity.features([b"you idiot", b"idiot a b c d e f g you", b""], marks)
    k = toxicity.FEATURES.index("hits_near_you")
    assert near[:, k].tolist() == [1, 0, 0] and not near[2].any()


def test_language_model_ignores_files_and_their_order(spark):
    import random

    from tests.llm.helpers import words

    rng = random.Random(8)
    rows = [(i, words(rng, 40, 80)) for i in range(240)] + [(900 + i, "same text in a third of the rows") for i in range(120)]
    kind = "doc_id long, text string"
    one = spark.createDataFrame(rows, kind).coalesce(1)
    eight = spark.createDataFrame(rows[::-1], kind).repartition(8)
    a, b = ({r.doc_id: r.score for r in lm.score_documents(df).collect()} for df in (one, eight))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6 * max(abs(x) for x in a.values())
