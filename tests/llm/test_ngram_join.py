import random

import pytest

from helpers import DOCS, jaccard_components, odd_rows, shingles, words
from vecflow.llm import ngram_join
from vecflow.llm.components import components


def near_copies(rng, n):
    base = [words(rng, 80, 5000).split() for _ in range(4)]
    line = words(rng, 14)
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        rows.append((i, " ".join(w) if rng.random() < 0.7 else line + " " + words(rng, rng.randrange(1, 60))))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # a row's candidates spread over several blocks
    rows = near_copies(random.Random(seed), 90)
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows)


def test_threshold_is_exact():
    # prefixes: a pair that meets the threshold shares one of the first n - ceil(t n) + 1 of any order
    for n in range(1, 200):
        need = -(-75 * n // 100)
        assert ngram_join.prefix_length(n) == n - need + 1


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = ngram_join.link_documents(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in got) == sorted(
        (r[0] if r[0] is not None else -1, len(shingles(r[1]))) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[0] == {0} and by[1] == {1} and by[2] == {2}  # without words: linked with nothing
    assert by[5] == by[6] == by[7] == by[8] == {5} and by[13] == by[14] == {13}
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and not {6, 7, 8, 14} & set(ids) and {0, 1, 2, 10, 11} <= set(ids)
    assert ids.count(3) == 2 and ids.count(None) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert ngram_join.link_documents(df).count() == 0 and ngram_join.deduplicated(df).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    from helpers import Union
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}
