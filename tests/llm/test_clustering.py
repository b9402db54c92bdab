import hashlib

import numpy as np
import pytest

from vecflow.llm import clustering as cl

KIND = "vec_id long, embedding array<float>, cluster int, ids string"


def brute(rows, dim, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in e]) for i, e in rows
            if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]
    kept = [(i, [max(min(c, cl.TOP), -cl.TOP) for c in e]) for i, e in kept]
    kept.sort(key=lambda v: (hashlib.sha256(f"3:{'null' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centroids = [list(e) for _, e in kept[:k]]

    def assigned():
        out = []
        for _, e in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centroids)))
        return out
    for _ in range(rounds):
        near = assigned()
        for n in range(len(centroids)):
            own = [e for (_, e), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assigned()
    spread = [sum(d for d, m in near if m == n) for n in range(len(centroids))]
    return sorted(((i, m, d, spread[m], sum(spread), hashlib.sha256(",".join(map(str, centroids[m])).encode()).hexdigest())
                   for (i, _), (d, m) in zip(kept, near)), key=repr)


def run(spark, rows, dim, parts=3):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], KIND).repartition(parts)
    return sorted(map(tuple, cl.cluster_report(df, dim=dim).collect()), key=repr)


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(cl, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    hot = [0.25, -0.5, 0.125, 1.0, 0.0, -0.001]  # a third of the rows are one vector
    rows = [(i, hot if i % 3 == 0 else [float(np.float32(x)) for x in rng.standard_normal(6) + (i % 5)]) for i in range(200)]
    assert run(spark, rows, 6) == brute(rows, 6)


def test_odd_rows(spark):
    a, nan, inf = [0.5, -0.25], float("nan"), float("inf")
    rows = [(1, a), (1, [2.0, 2.0]), (2, a), (2, a), (None, [1.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0]),
            (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [3e38, -3e38])]
    got = run(spark, rows, 2)
    assert got == brute(rows, 2) and len(got) == 6
    assert got[-1][2] >= 0


def test_empty_table_and_few_vectors(spark):
    assert run(spark, [], 4) == []
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (6, None)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_dictionaries_lose_nothing_and_join():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-5, 5, (30, 8)), 20, axis=0)  # copies: wide blocks
    blocks = cl.dictionaries(x)
    assert len(blocks) == 1 and len(blocks[0][1]) == len(np.unique(x, axis=0))
    y = rng.integers(-500, 500, (600, 8))
    for z in (x, y):
        found = cl.dictionaries(z)
        assert (np.concatenate([e[c] for _, e, c in found], axis=1) == z).all()
        c = rng.integers(-500, 500, (3, 8))
        near, distance = cl.assign(found, c)
        full = ((z[:, None] - c[None]) ** 2).sum(axis=2)
        assert (near == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        assert (cl.sums_by_cluster(found, near, 3, 8) == np.stack([z[near == j].sum(axis=0) for j in range(3)])).all()
