"""Neighbours where queries visit many leaves: what travels, and that nothing is lost between shards and parts of leaves."""

import numpy as np
import pytest

from phonolith.llm import neighbours as nb
from test_neighbours import SCHEMA, brute, lists_of


def test_a_block_visits_thousands_of_leaves(spark):
    """1,024 queries of 96 components that visit thousands of leaves: a block's copies for all leaves were one batch of over 2 GB."""
    x = np.random.default_rng(4).normal(size=(12000, 96))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA)
    got = nb.nearest(spark, rows, "vec_id < 1024", k=5, leaf_rows=8).toPandas()
    scores = x[:1024] @ x.T
    scores[np.arange(1024), np.arange(1024)] = -np.inf
    found = got.groupby("query_id").vec_id.agg(set)
    assert len(got) == 5 * 1024 and np.mean([len(found[q] & set(np.argsort(-s)[:5].tolist())) / 5 for q, s in enumerate(scores)]) >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_shards_and_parts_lose_nothing(spark, monkeypatch, kind):
    """Leaves of several parts, shards of a few parts, blocks of a few queries: with all leaves visited the search is exact."""
    for name, value in {"CHUNK": 7, "BLOCK": 5, "SHARD_BYTES": 16 * 4 * 8, "SCORED": 11, "RECALL": 1.0}.items():
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(400)] + [(None, [2.0, 1.0, 0.0, 1.0]), (500, [2.0, 1.0, 0.0, 1.0]), (520, [1.0, 1.0])]
    got = nb.nearest(spark, spark.createDataFrame(rows, SCHEMA.replace("float", kind)), "vec_id % 20 = 0", k=6, recall=2.0, leaf_rows=60)
    assert lists_of(got) == dict(brute(rows, 6, 20))


def test_visited_leaves_hold_those_of_best_bin_first():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, q = nb.Tree(nb.lifted(x, 1.0), 20), nb._directions(x[:50])
    assert len(tree.levels) > 2
    for most in (1, 2, 17, len(tree.leaves), 10**6):
        seen = tree.visited(q, most)
        for own, order in zip(seen, tree.visits(q, most), strict=True):
            assert set(order) <= {leaf for leaf, is_in in zip(tree.leaves, own, strict=True) if is_in}
    assert tree.visited(q, 17).sum(1).mean() < 25


def test_norms_and_keys(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [-0.0, 2.0]), (3, [0.0, 2.0]), (4, [0.0]), (5, [1e308, 1e308]), (6, []), (7, None), (8, [1.0, None]), (9, [float("nan")])], "vec_id long, embedding array<double>")
    own = nb.usable(rows)
    found = {r.vec_id: r for r in own.collect()}
    assert set(found) == {1, 2, 3, 5} and found[2].key == found[3].key != found[1].key
    assert nb._measured(own.where("vec_id < 5")) == (3, 2, 5.0) and nb._measured(own) == (4, 2, 1e308)
    assert [r.vec_id for r in nb.usable(rows, "vec_id % 3 = 0").collect()] == [3]
    assert nb._measured(own.limit(0)) == (0, 0, 0.0)
