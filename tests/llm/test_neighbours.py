"""Neighbours against a search over all rows."""

import math

import numpy as np
import pytest

from phonolith.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    """{query row number: [(vec_id, score)]}"""
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q is not None and q % every == 0:
            near = [(-sum(float(x) * float(y) for x, y in zip(v, w)), i is None, i or 0, i) for b, (i, w) in enumerate(ok) if b != a]
            out.append((q, [(i, -s) for s, _, _, i in sorted(near)[:k]]))
    return out


def lists_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(found, key=lambda x: x[0])] for q, found in out.items()}


def recall_of(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in found}) / max(1, len(found)) for q, found in want])


def test_one_leaf_is_exact(spark):
    """Ties, repeated rows, copies in plenty, rows without id and vectors that take no part."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(100, 190)]
    rows += [(None, [2.0, 1.0, 0.0, 0.0]), (200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 1.0]), (280, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf")] * 4), (320, [1.0, 1.0]), (340, [-0.0, 1.0, 0.0, 0.0]), (341, [0.0, 1.0, 0.0, 0.0])]
    got = lists_of(nb.nearest(spark, spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0", k=7))
    assert got == dict(brute(rows, 7, 20))
    twice = rows[:40] + [(20, rows[20][1]), (20, [1.0, 1.0, 1.0, 1.0])]
    got = nb.nearest(spark, spark.createDataFrame(twice, SCHEMA), "vec_id % 20 = 0", k=5).collect()
    want = [(q, n + 1, i, s) for q, found in brute(twice, 5, 20) for n, (i, s) in enumerate(found)]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("kind", ["noise", "clusters", "unequal norms"])
def test_recall_on_many_leaves(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.2 * x
    if kind != "unequal norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    tree = nb.Tree(nb.lifted(x.astype(float), float(np.linalg.norm(x.astype(float), axis=1).max())), 100)
    assert len(tree.leaves) > 25
    want = brute([r for r in rows if r[0] % 50 == 0], 10, 50) and [(q, sorted(((i, float(s)) for i, s in enumerate(x.astype(float) @ x[q].astype(float)) if i != q), key=lambda h: (-h[1], h[0]))[:10]) for q in range(0, 3000, 50)]
    got = lists_of(nb.nearest(spark, spark.createDataFrame(rows, SCHEMA), "vec_id % 50 = 0", k=10, leaf_rows=100))
    assert set(got) == {q for q, _ in want} and recall_of(got, want) >= 0.9
    exact = dict(want)
    for q, found in got.items():
        assert len(found) == 10 and all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-12 for i, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert found[0][1] <= exact[q][0][1] + 1e-12


def test_best_bin_first_visits_the_nearest_leaf_first_and_all_in_the_end():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = nb.Tree(nb.lifted(x, 1.0), 50)
    q = nb._directions(x[:30])
    for whole, first in zip(tree.visits(q, 10**6), tree.visits(q, 3), strict=True):
        assert sorted(whole) == tree.leaves and whole[:3] == first
    inside = tree.leaf_of(nb.lifted(x, 1.0))
    assert np.mean([leaf == order[0] for leaf, order in zip(inside[:30], tree.visits(q, 1), strict=True)]) > 0.8


def test_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], "x", b"k")], SCHEMA + ", key string, leaf binary")
    assert nb.nearest(spark, rows, "vec_id % 20 = 0").count() == 0  # no candidate
    assert nb.nearest(spark, rows.limit(0), "vec_id % 20 = 0").count() == 0
    huge = spark.createDataFrame([(0, [1e308, 1e308]), (1, [1e-300, 0.0]), (2, [-1e308, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nb.nearest(spark, huge, "vec_id % 20 = 0").orderBy("rank").collect()] == [1, 2]
