import numpy as np
import pytest

from vecflow.llm import embedding_dedup as ed

KIND = "vec_id long, embedding array<float>, label int, data string, key string"


def clusters(rng, groups, size, dim, spread):
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        out += [c / np.linalg.norm(c) + spread * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(size)]
    return out


def brute(rows, threshold=0.98):
    """{id: (links, component)} by all pairs in double precision; rows of equal label and length."""
    unit = {r[0]: ed.unit(r[1]) if r[2] is not None else None for r in rows}
    label = {r[0]: r[2] for r in rows}
    ids = [i for i in unit if unit[i] is not None]
    links = {i: 0 for i in unit}
    up = {i: i for i in unit}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in unit}


@pytest.mark.parametrize("block", [1024, 5])
def test_recall_and_components(spark, block, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", block)  # hot buckets in many block pairs: counts must not change
    rng = np.random.default_rng(1)
    vecs = clusters(rng, 12, 12, 64, 0.13) + clusters(rng, 1, 60, 64, 0.01) + list(rng.standard_normal((150, 64)))
    rows = [(i, [float(np.float32(x)) for x in v], i % 2, "", "") for i, v in enumerate(vecs)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    want = brute(rows)
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all_links > 2000 and found >= 0.97 * all_links
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold


def test_odd_rows(spark):
    a = [1.0, 2.0] + [0.5] * 14
    rows = [(1, a, 0, "", ""), (2, [2 * x for x in a], 0, "", ""), (3, a, 1, "", ""), (4, a, None, "", ""), (5, None, 0, "", ""), (6, [], 0, "", ""),
            (7, [0.0] * 16, 0, "", ""), (8, [None] + a[1:], 0, "", ""), (9, [float("nan")] + a[1:], 0, "", ""), (10, [float("inf")] + a[1:], 0, "", ""),
            (11, a, 0, None, None), (11, a, 0, None, None), (None, a, 0, "", ""), (12, a[:8], 0, "", ""), (13, [-x for x in a], 0, "", "")]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in ed.link_vectors(spark.createDataFrame(rows, KIND)).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (11, 3, 1, False)]
    assert got == sorted(alone + linked + [(0, 0, None, True)], key=repr)


def test_empty_table(spark):
    assert ed.link_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_rotation_is_orthogonal_and_balances():
    x = np.random.default_rng(2).standard_normal((2000, 16)) * np.linspace(0.2, 3, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = ed.learn_rotation(x, 1)
    assert np.allclose(r.T @ r, np.eye(16))
    plain = np.abs(x @ np.linalg.eigh(x.T @ x)[1])
    assert np.abs(x @ r).mean() > plain.mean()  # nearer to the corners of the cube than the principal axes


def test_a_pair_counts_in_one_table_only():
    x = np.eye(4)[[0, 0, 1]]
    codes = np.array([[1, 2, 3], [1, 2, 3], [9, 9, 9]], dtype=np.int32)
    counts = sum(ed.compare(x, codes, t, np.ones(3), None, 0.98)[0] for t in range(3))
    assert counts.tolist() == [1, 1, 0]
