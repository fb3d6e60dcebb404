"""Exact and near deduplication against brute force and on edge cases."""

import random
from collections import Counter

import pytest
from llm_helpers import components_of, jaccard_links, shingles
from pyspark.sql import functions as F

from phonolith.llm import exact_dedup as ed
from phonolith.llm import near_dedup as nd


def test_cuckoo_shard_inserts_deletes_and_resizes():
    shard = ed.CuckooShard(4)
    keys = [ed.digest_of(str(i)) for i in range(5000)]
    for i, k in enumerate(keys):
        shard.insert(k, i)
    assert shard.resizes > 0 and all(shard.find(k) == i for i, k in enumerate(keys))
    for k in keys[::2]:
        assert shard.delete(k) and not shard.delete(k)
    assert all(shard.find(k) is None for k in keys[::2]) and all(shard.find(k) == i for i, k in enumerate(keys) if i % 2)
    assert sum(shard.maybe(ed.digest_of(f"other {i}")) for i in range(2000)) < 20


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["ab", "c d"][: rng.randint(1, 2)]) + " " * rng.randint(0, 3) + str(rng.randint(0, 9))) for i in range(300)]
    got = {r.doc_id: r for r in ed.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), keys_per_shard=8).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(ed.digest_of(t), []).append((-len(t), i))
    for i, t in rows:
        group = groups[ed.digest_of(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(group)[1], len(group), min(group)[1] == i)


def test_exact_edges(spark, edge_docs, empty_docs):
    got = ed.exact_dedup(spark, edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].keep_id == 3 and by[3].kept and by[1].group_size == 3
    assert by[4].keep_id == 6 and by[5].keep_id == 6 and by[4].group_size == 4  # null, empty and blank; the longest stays
    assert ed.exact_dedup(spark, empty_docs).count() == 0
    kept = ed.keep_first(spark, edge_docs)
    assert kept.columns == edge_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 6, 7, 8, 9, 10]


def test_index_inserts_and_deletes(spark):
    docs = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    index = ed.insert(ed.build_index(docs(range(50)), 4), docs(range(40, 70)), 4)
    index = ed.delete(index, docs(range(0, 10)), 4)
    live = {r.doc_id for r in ed.lookup(index, docs(range(80)), 4).where("live_id is not null").collect()}
    assert live == set(range(10, 70))


@pytest.mark.parametrize("large", [False, True])
def test_near_components_match_brute_force(spark, large, monkeypatch):
    """With large buckets, members, hubs and strays of several chunks are compared as well."""
    if large:
        monkeypatch.setattr(nd, "SMALL", 3)
        monkeypatch.setattr(nd, "CHUNK", 4)
    rng, texts = random.Random(5), []
    for g in range(12):
        base = [f"w{g}x{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 9)}"
            texts.append(" ".join(t))
    texts += [None, "", "a b", "A B", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components_of(len(texts), jaccard_links(texts))
    got = {r.doc_id: r for r in nd.near_dedup(spark, docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_near_edges(spark, edge_docs, empty_docs):
    got = nd.near_dedup(spark, edge_docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert len(got) == edge_docs.count() and by[2].component_id == 1 and by[3].component_id == 1 and by[4].component_id == 4 and by[9].n_shingles == 1
    assert nd.near_dedup(spark, empty_docs).count() == 0
    assert sorted((r.doc_id or 0) for r in nd.keep_one(spark, edge_docs).collect()) == [0, 0, 1, 4, 5, 6, 7, 7, 8, 9, 10]


def test_posterior_bound_rises_with_batches():
    least = [nd.least_matches(n) for n in (32, 64, 96, 128)]
    assert least == sorted(least) and least[0] < 0.75 * 32 and least[-1] < 0.75 * 128


def test_pairs_of_one_set_are_one_node(spark):
    rows = [(i, "the same five words and more") for i in range(40)] + [(100, "THE same five words and more")]
    got = nd.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 1 and got.agg(F.max("component_id")).first()[0] == 0


def test_strays_of_large_buckets_meet_in_bounded_cells(spark, monkeypatch):
    """No cell holds all strays of a bucket, and each stray meets each other member in one cell."""
    monkeypatch.setattr(nd, "CHUNK", 8)
    members = [(1, 0, b"s%d" % i, b"s%d" % i, b"m", 100, 40, 900, 300) for i in range(60)] + [(1, 0, b"m%d" % i, b"m", b"m", 100, 40, 900, 300) for i in range(40)]
    mixed = spark.createDataFrame(members, "bucket long, band int, node binary, root binary, main binary, n long, most long, weight long, main_weight long")
    cells = {}
    for r in nd.in_cells(mixed).collect():
        cells.setdefault((r.a, r.b), []).append((bytes(r.node), r.left))
    assert max(map(len, cells.values())) < 60
    met = Counter()
    for (a, b), rows in cells.items():
        if a == b:
            met.update(frozenset((x, y)) for k, (x, _) in enumerate(rows) for y, _ in rows[:k])
        else:
            met.update(frozenset((x, y)) for x, of in rows if of for y, left in rows if not left)
    assert len(met) == 60 * 59 // 2 + 60 * 40 and set(met.values()) == {1}


def test_template_like_texts_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 16)
    rng, common, texts = random.Random(11), [f"c{i}" for i in range(120)], []
    for i in range(160):
        own = [f"o{i // 2}x{j}" for j in range(40)]
        texts.append(" ".join(common + own[: 38 + i % 2 * 2] + [f"t{rng.randrange(10**9)}"]))
    got = nd.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(components_of(len(texts), jaccard_links(texts))))


def test_a_chunk_gives_a_forest(spark):
    """300 near copies of one bucket give under 300 pairs in a chunk, and they join what all pairs would join."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sigs = [nd.signature(np.where(rng.random(300) < 0.04, rng.integers(0, 2**63, 300, dtype=np.uint64), base)).tobytes() for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"bucket": [7] * 300, "chunk": pa.array([0] * 300, pa.int32()), "node": [b"n%03d" % i for i in range(300)], "sig": sigs, "n_shingles": [300] * 300})
    pairs = [p for out in nd._forests(iter([batch])) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    forest = nd.Forest(300)
    assert len(pairs) == 299 and all(forest.join(int(a[1:]), int(b[1:])) for a, b in pairs)


def test_large_ids_beside_nulls(spark):
    """Ids above 2**53 come back as they are, whatever else is null."""
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "one two three four five six"), (big + 2, "one two three four five six"), (None, "one two three four five six "), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ed.exact_dedup(spark, docs).where("text_sha256 <> '' and doc_id is not null").collect()}
    assert set(got) == {big, big + 2} and got[big].keep_id is None  # the longest text has no id
    two = {r.doc_id: r for r in ed.exact_dedup(spark, docs.where("doc_id is not null or text is null")).collect()}
    assert two[big].keep_id == big and two[big].kept and two[big + 2].keep_id == big and not two[big + 2].kept
    near = {r.doc_id: r.component_id for r in nd.near_dedup(spark, docs).collect() if r.doc_id}
    assert near == {big: big, big + 2: big}


def test_texts_without_ids_meet_equal_texts_only(spark, monkeypatch):
    """A third of the rows has no id: each asked set meets the texts that equal its own, and links are those of brute force."""
    seen = []
    kept = nd.Scratch.keep
    monkeypatch.setattr(nd.Scratch, "keep", lambda self, df, name: (seen.append((name, kept(self, df, name))), seen[-1][1])[1])
    rng = random.Random(8)
    texts = []
    for g in range(20):
        base = [f"w{g}x{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(6):
            t = list(base)
            t[rng.randrange(60)] = f"e{rng.randint(0, 9)}"
            texts.append(" ".join(t))
    rows = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)]
    got = nd.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    roots = components_of(len(texts), jaccard_links(texts))
    least = {}
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            least[root] = min(least.get(root, i), i)
    want = sorted((rows[i][0] or -1, least.get(root, -1)) for i, root in enumerate(roots))
    assert sorted((r.doc_id or -1, -1 if r.component_id is None else r.component_id) for r in got) == want
    sets = [df.count() for name, df in seen if name.startswith("sets-") and not name.startswith("sets-asked")]
    asked = [df.count() for name, df in seen if name.startswith("sets-asked")]
    assert sets == asked
