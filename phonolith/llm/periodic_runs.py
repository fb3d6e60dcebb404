"""Periodic runs of words, found on a grammar of the text.

Documents are independent and small next to the table, so each is worked off within a task; several short ones share one
array, with word ids of their own. Re-Pair turns the ids into a grammar: all frequent pairs that beat their neighbours
become nonterminals at once, most frequent first, until no pair occurs twice. A run lies across the boundary of exactly
one smallest nonterminal or of the remaining sequence, so only boundaries are looked at, a nonterminal's once however
often it occurs. Its runs are translated to every place it was put in, and overlapping intervals of a period are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.llm.common import WORD, mix

LEAST = 6
POWERS = 4
#: Words of documents that share one array, about; a longer document has its own.
TOGETHER = 1 << 17
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Rules as places in the text: a nonterminal's first start, its boundary, its end; and where each was put in."""

    def __init__(self, ids: np.ndarray, least: int):
        self.first, self.cut, self.end, self.rule, self.start = ([] for _ in range(5))
        n_rules, bound = 0, int(ids.max()) + 1 if len(ids) else 1
        symbols, at, length = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
        open_ = np.ones(max(0, len(ids) - 1), bool)  # pairs that may occur twice
        while len(pairs := np.flatnonzero(open_)):
            key = symbols[pairs] * bound + symbols[pairs + 1]
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order[1:]] != key[order[:-1]])
            group, count = np.empty(len(pairs), np.int64), np.diff(np.append(np.flatnonzero(new), len(pairs)))
            group[order] = np.cumsum(new) - 1
            often = count[group]
            open_[pairs] = often > 1
            if count.max() < 2:
                break
            # frequent first, by powers of two; chance decides between equals, so many win in each round
            rank = np.full(len(open_) + 2, np.iinfo(np.int64).max)
            rank[pairs[often > 1] + 1] = ((60 - np.log2(often[often > 1]).astype(np.int64)) << 56) | (mix(key[often > 1].astype(np.uint64)) >> np.uint64(8)).astype(np.int64)
            edge = np.append(np.flatnonzero(rank[1:] != rank[:-1]) + 1, len(rank))  # a symbol repeated gives equal ranks in a row
            begin, value = np.append(0, edge[:-1]), rank[np.append(0, edge[:-1])]
            wins = np.append(False, value[1:] < value[:-1]) & np.append(value[:-1] < value[1:], False)
            sizes = (edge - begin)[wins]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chosen = (np.repeat(begin[wins], sizes) + within)[within % 2 == 0] - 1
            used, rule = np.unique(group[np.searchsorted(pairs, chosen)], return_inverse=True)
            size = length[chosen] + length[chosen + 1]
            first = np.full(len(used), len(ids))
            np.minimum.at(first, rule, at[chosen])
            whole = np.empty(len(used), np.int64), np.empty(len(used), np.int64)
            whole[0][rule], whole[1][rule] = length[chosen], size
            long = whole[1] >= least  # no run fits into shorter ones
            self.first.append(first[long])
            self.cut.append((first + whole[0])[long])
            self.end.append((first + whole[1])[long])
            name = np.cumsum(long) - 1 + n_rules
            self.rule.append(name[rule[long[rule]]])
            self.start.append(at[chosen][long[rule]])
            n_rules += int(long.sum())
            symbols[chosen], length[chosen] = bound + rule, size
            bound += len(used)
            open_[chosen[chosen > 0] - 1] = True
            after = chosen[chosen + 1 < len(open_)] + 1
            open_[after] = True
            kept = np.ones(len(symbols), bool)
            kept[chosen + 1] = False
            symbols, at, length = symbols[kept], at[kept], length[kept]
            stays = np.ones(len(open_), bool)
            stays[chosen] = False
            open_ = open_[stays]
        self.top = at[1:]
        for name in ("first", "cut", "end", "rule", "start"):
            setattr(self, name, np.concatenate([np.zeros(0, np.int64), *getattr(self, name)]))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every index from low up to high, and whose it is."""
    n = np.maximum(0, high - low)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[owner]


def _squares(ids: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray, extend) -> None:
    """Calls extend(forward, boundary numbers, periods) for squares that begin (or end) at a boundary, by growing period.

    Grams of m words name the squares of periods m to 2m - 1. extend returns the known start and end of runs at each
    boundary: a square within a run of a smaller period is not primitive and is left out.
    """
    n, m = len(ids), 1
    name, live = ids.astype(np.int64), np.arange(n)
    left, right = cut.copy(), cut.copy()  # known runs at the boundary reach from here to there
    while len(live):
        key = name[live] if m == 1 else name[live] * n + name[live + m // 2]
        order = np.argsort(key, kind="stable")
        key, place = key[order], live[order]
        new = np.append(True, key[1:] != key[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(key)))
        group = np.cumsum(new) - 1
        twice = count[group] > 1
        name = np.full(n, -1)
        place, group = place[twice], group[twice]
        name[place] = group
        keyed = group * n + place  # sorted
        for forward in (True, False):
            gram = cut if forward else cut - m
            ok = (gram >= low) & (gram + m <= high) & ((right < cut + 4 * m) if forward else (left > cut - 4 * m))
            ok[ok] = name[gram[ok]] >= 0
            which = np.flatnonzero(ok)
            g = gram[which]
            a, b = (g + m, np.minimum(g + 2 * m, n)) if forward else (np.maximum(g - 2 * m + 1, 0), np.maximum(g - m + 1, 0))
            owner, i = _spread(np.searchsorted(keyed, name[g] * n + a), np.searchsorted(keyed, name[g] * n + b))
            which, q = which[owner], np.abs(place[i] - g[owner])
            at, inside = cut[which], 2 * q
            ok = (at + inside <= np.minimum(high[which], n)) & (at + inside > right[which]) if forward else (at - inside >= np.maximum(low[which], 0)) & (at - inside < left[which])
            which, q, at = which[ok], q[ok], at[ok]
            one, two = (at + q - m, at + 2 * q - m) if forward else (at - q, at - 2 * q)
            ok = (name[one] >= 0) & (name[one] == name[two])
            if ok.any():
                s, e = extend(forward, which[ok], q[ok])
                np.minimum.at(left, which[ok], s)
                np.maximum.at(right, which[ok], e)
        live = np.sort(place)
        live = live[live + m < n]
        live = live[name[live + m] >= 0]
        m *= 2


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST, powers: int = POWERS) -> np.ndarray:
    """(start, end, period) of every run by start, then period. offsets: where each document of the array begins, and its end."""
    if powers < 4:
        raise ValueError("a boundary must leave two periods of a run on one of its sides")
    grammar, n = Grammar(ids, max(least, powers)), len(ids)
    cut = np.concatenate([grammar.top, grammar.cut])
    low = np.concatenate([np.zeros(len(grammar.top), np.int64), grammar.first])
    high = np.concatenate([np.full(len(grammar.top), n), grammar.end])
    found: list[np.ndarray] = []

    def extend(forward: bool, which: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        order = np.argsort(q, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(q[order])) + 1):
            period, at = int(q[part[0]]), cut[which[part]]
            a = int(offsets[np.searchsorted(offsets, at.min() - 1, "right") - 1])
            b = int(offsets[np.searchsorted(offsets, at.max(), "right")]) if at.max() < n else n
            differ = np.concatenate([[a - 1], np.flatnonzero(ids[a : b - period] != ids[a + period : b]) + a, [b - period]])
            k = np.searchsorted(differ, at if forward else at - 1 - period)  # a word of the square that has a partner after it
            s[part], e[part] = differ[k - 1] + 1, differ[k] + period
        found.append(np.stack([which, s, e, q], 1))
        return s, e

    _squares(ids, cut, low, high, extend)
    if not found:
        return np.zeros((0, 3), np.int64)
    which, s, e, q = np.concatenate(found).T
    s, e = np.maximum(s, low[which]), np.minimum(e, high[which])
    ok = (e - s >= np.maximum(least, powers * q)) & (s < cut[which]) & (cut[which] < e)
    which, s, e, q = which[ok], s[ok], e[ok], q[ok]
    top = which < len(grammar.top)
    rule, order = which[~top] - len(grammar.top), np.argsort(grammar.rule, kind="stable")
    sorted_rules = grammar.rule[order]
    owner, i = _spread(np.searchsorted(sorted_rules, rule), np.searchsorted(sorted_rules, rule, "right"))
    move = grammar.start[order[i]] - grammar.first[rule[owner]]
    placed = np.concatenate([np.stack([s, e, q], 1)[top], np.stack([s[~top][owner] + move, e[~top][owner] + move, q[~top][owner]], 1)])
    return _merged(placed)


def _merged(runs: np.ndarray) -> np.ndarray:
    """Intervals of a period that overlap by it are one."""
    s, e, q = np.unique(runs[:, [2, 0, 1]], axis=0)[:, [1, 2, 0]].T
    out: list[list[int]] = []
    for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True):
        if out and out[-1][2] == p and a <= out[-1][1] - p:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, p])
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)


def _group(docs: list[tuple[int | None, list[bytes]]], least: int, powers: int) -> pa.RecordBatch:
    parts, offsets, base = [], [0], 0
    for _, words in docs:
        ids, n = _ids(words)
        parts.append(ids + base)
        base += n
        offsets.append(offsets[-1] + len(words))
    offsets = np.array(offsets)
    runs = runs_of(np.concatenate(parts), offsets, least, powers)
    of = np.searchsorted(offsets, runs[:, 0], "right") - 1
    out: list[list] = [[], []]
    for k, (_, words) in enumerate(docs):
        own = runs[np.searchsorted(of, k) : np.searchsorted(of, k, "right")] - [offsets[k], offsets[k], 0]
        out[0].append([{"start": int(s), "length": int(e - s), "period": int(q)} for s, e, q in own])
        if len(own):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, own[:, 0] + own[:, 2], 1)
            np.add.at(gone, own[:, 1], -1)
            words = list(compress(words, (np.cumsum(gone)[:-1] == 0).tolist()))
        out[1].append(b" ".join(words))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in docs], pa.int64()), pa.array(np.diff(offsets)), pa.array(out[0], kind), pa.array(out[1], pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def find_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """doc_id, n_words, runs and the text without what repeats, for each row of docs(doc_id, text).

    A run is a maximal stretch of words with smallest period q and a length of at least max(least, powers * q), powers at
    least 2; `runs` has start, length and period by start, then period. `collapsed` joins by one space the words that lie
    in no run after its first q words. Null and blank texts have no words, no runs and an empty `collapsed`; rows are
    independent, so repeated rows and null ids come back as they are; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                waiting.append((doc_id, words))
                size += len(words)
                if size >= TOGETHER:
                    yield _group(waiting, least, powers)
                    waiting, size = [], 0
            if waiting:
                yield _group(waiting, least, powers)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(work, SCHEMA)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id, text; of the documents with h % 10 = 0 the words from a on repeat the first p of them.

    h: crc32 of the id in decimals, g = h div 10, n words, a = g % n, p = 1 + (n - a) div (3 + g % 8). Rows without an id
    stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words: Column = F.when(chosen, F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), words.alias("words"), F.floor(h / 10).alias("g"))
    own = own.withColumn("n", F.size("words"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    looped = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, cast(1 + a + (i - a) % p as int)))), ' ')")
    return own.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run and hashes of what find_runs returns; four nulls where there is no run."""
    stronger = """array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1
        when x.length * y.period < y.length * x.period then 1 when x.start < y.start then -1 when x.start > y.start then 1
        when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)"""
    best = found.withColumn("best", F.expr(f"get({stronger}, 0)"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
