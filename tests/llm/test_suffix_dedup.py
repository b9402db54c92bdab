import collections
import random

import numpy as np
import pytest

from helpers import DOCS, cut_repeats, odd_rows, sha256, words
from vecflow.llm import suffix_dedup as sd


def test_two_stage_order_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(40):
        parts = [bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randrange(1, 60))) for _ in range(6)] + [b"ab" * 40, b"z" * 30]
        ends = np.cumsum([len(p) for p in parts])
        data = b"".join(parts)
        sa = sd.two_stage_suffixes(data, ends, 1000)
        suffix = {i: data[i:ends[np.searchsorted(ends, i, side="right")]] for i in range(len(data))}
        assert sorted(sa.tolist()) == list(range(len(data)))
        assert [suffix[i] for i in sa.tolist()] == sorted(suffix.values())


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(40):
        length = rng.choice([40, 64])
        pool = [bytes(rng.choice(rng.choice([b"ab", b"abcdefgh"])) for _ in range(rng.randrange(200))) for _ in range(5)] + [b"ab" * 100, b"x" * 150]
        parts = [b"".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(8)]
        seen = collections.Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        for p, flags in zip(parts, sd.repeated_windows(parts, length)):
            assert flags.tolist() == [seen[p[i:i + length]] > 1 for i in range(len(p) - length + 1)]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 499, 500):
        assert sd.sliding_min(x, w).tolist() == [int(x[i:i + w].min()) for i in range(500 - w + 1)]


def corpus(seed):
    rng = random.Random(seed)
    line, passage, base = words(rng, 12), words(rng, 120, 3000), words(rng, 200, 3000)
    rows = []
    for i in range(160):
        r = rng.random()
        if r < 0.2:
            t = words(rng, rng.randrange(80))
        elif r < 0.4:
            t = words(rng, 20) + line + words(rng, 60)
        elif r < 0.6:
            t = words(rng, rng.randrange(30)) + passage[rng.randrange(200):] + words(rng, rng.randrange(30))
        elif r < 0.75:
            w = base.split()
            w[rng.randrange(len(w))] = "édité"
            t = " ".join(w)
        elif r < 0.85:
            t = base
        elif r < 0.92:
            t = "hey " * rng.randrange(1, 300)
        else:
            t = (words(rng, 60) + " ") * 2
        rows.append((i, t, "e", i, i))
    return rows


# the large-group ways must give the same as the plain one
@pytest.mark.parametrize("length,split,group", [(400, 64, 4096), (64, 3, 4096), (100, 2, 3)])
def test_matches_brute_force(spark, length, split, group, monkeypatch):
    monkeypatch.setattr(sd, "SPLIT", split)
    monkeypatch.setattr(sd, "GROUP", group)
    rows = corpus(length) + odd_rows()
    got = sd.removal_report(spark.createDataFrame(rows, DOCS).repartition(4), length).collect()
    want = cut_repeats([r[1] for r in rows], length)
    assert sum(w[1] > 0 for w in want) > 60
    assert collections.Counter(map(tuple, got)) == collections.Counter(
        (r[0], len((r[1] or "").encode()), w[1], w[2], sha256(w[0])) for r, w in zip(rows, want))


def test_deduplicated_texts(spark):
    rows = corpus(3)
    got = sd.deduplicated(spark.createDataFrame(rows, DOCS), 100)
    assert got.columns == ["doc_id", "text", "extra", "n", "key"]
    want = {r[0]: w[0].decode(errors="ignore") for r, w in zip(rows, cut_repeats([r[1] for r in rows], 100))}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 300)
    text = words(random.Random(1), 400).encode()
    covered = set()
    for owner, at, stop, _, _, _, shift, _ in sd.segments([text, b"", text[:99]], 100):
        for row, a, z, s in zip(owner.tolist(), at.tolist(), stop.tolist(), shift.tolist()):
            assert row == 0
            here = set(range(a + s, z + s))
            assert not covered & here
            covered |= here
    assert covered == set(range(len(text) - 99))


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert sd.removal_report(df).count() == 0 and sd.deduplicated(df).count() == 0
