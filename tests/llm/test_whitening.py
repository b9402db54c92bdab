import numpy as np
import pytest

from vecflow.llm import whitening as wh

KIND = "vec_id long, embedding array<float>, n long, component string"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], KIND).repartition(parts)
    return wh.whiten(df).collect()


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


def test_counts_are_the_inertia():
    rng = np.random.default_rng(1)
    for values in ([3, 2, 1, 0, -1, -4], [5, 5, 5, 1, 1, -2], list(rng.standard_normal(20) * 100)):
        a = symmetric(rng, values)
        for s in [*(np.array(values) + 1e-6), *(np.array(values) - 1e-6), 1000, -1000]:
            assert wh.count_above(a, s) == (np.array(values) > s).sum()
    assert wh.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # a 2 by 2 pivot
    assert wh.count_above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [[9, 7, 5, 3, 1], [4, 4, 4, 1, 0.5], [1e6, 1, 1 - 1e-9, 1e-3, 0], [2, 2, 2, 2, 2], [1, 0, 0, 0, 0]])
def test_leading_pairs(values):
    a = symmetric(np.random.default_rng(2), values)
    for k in (1, 3, 5):
        found, vectors = wh.leading_pairs(a, k)
        assert np.allclose(found, sorted(values)[::-1][:k], atol=1e-12 * max(values))
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
        assert np.abs(a @ vectors - vectors * found).max() < 1e-12 * max(values)


def test_intervals_hold_one_eigenvalue_each():
    a = symmetric(np.random.default_rng(3), [5, 4, 4 - 1e-5, 1, 0.1])
    found = wh.isolate(a, 3, 1e-12)
    assert [(f[2], f[3]) for f in found] == [(1, 1), (2, 2), (3, 3)]
    assert all(lo < v <= hi for (lo, hi, _, _), v in zip(found, [5, 4, 4 - 1e-5]))


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((150, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a third of the rows are one vector: once in the fit
    got = run(spark, rows)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1][:16], vectors[:, ::-1][:, :16]
    want = (x - sums / n) @ vectors / np.sqrt(e)
    assert len(got) == len(rows) * 16 and {r.n for r in got} == {n}
    place = {r[0]: k for k, r in enumerate(rows)}
    z = np.zeros((len(rows), 16))
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * x[place[r.vec_id]] - sums) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / np.trace(y.T @ y / n)) < 1e-12
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [4.0, -1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, 2.0, 3.0]),
            (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0])]
    got = run(spark, rows)
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted([(i, c) for i in (1, 2, 2, 2, 0) for c in (1, 2)])
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9
    huge = run(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in huge)
    assert all(r.deviation is None for r in huge if r.vec_id == 1)


def test_tables_without_components(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # nothing varies
    flat = run(spark, [(i, [float(i), 5.0]) for i in range(10)])  # one component of two
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
