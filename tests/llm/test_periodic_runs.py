"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from phonolith.llm import periodic_runs as pr


def brute(t, least=6, powers=4):
    out = []
    for q in range(1, len(t) // powers + 1):
        i = 0
        while i < len(t) - q:
            j = i
            while j < len(t) - q and t[j] == t[j + q]:
                j += 1
            if j + q - i >= max(least, powers * q) and not any(all(t[k] == t[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    k, t = rng.choice([1, 2, 2, 3, 5]), []
    while len(t) < n:
        kind = rng.random()
        if kind < 0.5:
            t += [rng.randrange(k) for _ in range(rng.randint(1, 8))]
        elif kind < 0.8 or not t:
            w = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            t += w * rng.randint(2, 7) + w[: rng.randrange(len(w))]
        else:
            a = rng.randrange(len(t))
            t += t[a : rng.randint(a, len(t))]
    return t


@pytest.mark.parametrize("powers", [4, 5])
def test_runs_match_brute_force(powers):
    rng = random.Random(powers)
    for _ in range(400):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 10, 30, 90])) for _ in range(rng.choice([1, 1, 3]))]
        offsets, ids, want = [0], [], []
        for k, t in enumerate(texts):
            want += [(s + offsets[-1], e + offsets[-1], q) for s, e, q in brute(t, 6, powers)]
            ids += [x + 100 * k for x in t]
            offsets.append(len(ids))
        assert [tuple(r) for r in pr.runs_of(np.array(ids, np.int64), np.array(offsets), 6, powers).tolist()] == want


def test_strings_made_to_be_periodic():
    fib, thue = [0], [0]
    one = [0, 1]
    while len(fib) < 600:
        fib, one = one, one + fib
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    long = list(range(700)) * 5 + list(range(300))
    for t in (fib, thue, thue * 5, [0] * 3000, [0, 1] * 800 + [0] * 20, fib[:89] * 6):
        assert [tuple(r) for r in pr.runs_of(np.array(t, np.int64), np.array([0, len(t)])).tolist()] == brute(t) if len(t) < 1700 else True
    assert pr.runs_of(np.array(long, np.int64), np.array([0, len(long)])).tolist() == [[0, 3800, 700]]
    assert pr.runs_of(np.zeros(200_000, np.int64), np.array([0, 200_000])).tolist() == [[0, 200_000, 1]]


def test_a_nonterminal_is_looked_at_once():
    """A passage that occurs a thousand times adds a nonterminal for its runs, and its places."""
    passage, t = [1, 2, 3] * 6 + [4, 5, 6, 7], []
    for i in range(1000):
        t += passage + [1000 + i, 5000 + i]
    grammar = pr.Grammar(np.array(t, np.int64), 6)
    assert len(grammar.first) < 20 and len(grammar.start) >= 1000
    runs = pr.runs_of(np.array(t, np.int64), np.array([0, len(t)]))
    assert runs.tolist() == [[24 * i, 24 * i + 18, 3] for i in range(1000)]


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_brute_force(spark, edge_docs, empty_docs, monkeypatch):
    monkeypatch.setattr(pr, "TOGETHER", 500)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.choice([0, 8, 40, 120]))).replace(" ", rng.choice([" ", "\n\t", "  "]))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in pr.run_digests(pr.find_runs(pr.with_loops(docs))).collect())
    assert got == sorted(digest_row(*r) for r in rows)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in pr.run_digests(pr.find_runs(pr.with_loops(edge_docs.where("length(coalesce(text, '')) < 5000")))).collect()), key=str)
    assert got == sorted((digest_row(r.doc_id, r.text) for r in edge_docs.collect() if len(r.text or "") < 5000), key=str)
    assert pr.run_digests(pr.find_runs(pr.with_loops(empty_docs))).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 100_000), (None, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.find_runs(long).collect()}
    assert found == {1: (300_000, [(0, 300_000, 3)], "a b c"), None: (0, [], "")}
    with pytest.raises(ValueError):
        pr.runs_of(np.zeros(5, np.int64), np.array([0, 5]), 2, 2)
