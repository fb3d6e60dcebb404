"""Approximate nearest neighbours by inner product on a hierarchical k-means tree.

The tree is fitted on a bounded, hash-chosen sample; every vector is then dealt to a leaf, and leaves are written as
matrices of bounded size. Vectors get one more component that makes all norms equal, so that the nearest centre is the one
of the largest inner product. A query visits leaves best bin first: a priority queue holds the open nodes by distance. How
many leaves it visits is calibrated: queries of a sample are answered exactly over all rows, and visits are widened until
enough of these answers lie in the leaves visited. Leaves are put together to shards of bounded size; a block of queries
goes once to each shard in which it visits a leaf, so what travels grows with the shards and not with the leaves. Equal
vectors are one entry with their least ids, so a vector that fills the table is searched and scored once.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.llm.common import Scratch, broadcast_if_small

#: Vectors the tree is fitted on, and queries that calibrate the visits, about: hash-chosen samples.
TRAIN_ROWS = 1 << 15
CALIBRATION_QUERIES = 256
#: Vectors of a leaf, about; leaves have 8 sampled vectors at least, so there are at most TRAIN_ROWS / 8 of them.
LEAF_ROWS = 1024
BRANCHES = 8
#: Rows of a packed matrix, and queries of a block.
CHUNK, BLOCK = 2048, 1024
#: The lower bound of the calibrated recall, two standard errors below the mean, that ends the widening.
RECALL = 0.93
#: Bytes of the vectors of a shard, about, and candidates that are scored exactly or held for a query in one go.
SHARD_BYTES, SCORED, HELD = 48 << 20, 1 << 11, 4
KEY = 32


class Tree:
    """Centres of nested k-means, breadth first; children of a node lie side by side, a node without any is a leaf."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 20240517):
        rng = np.random.default_rng(seed)
        self.centres, self.first, self.n_children, self.parent, depth = [sample.mean(0)], [0], [0], [0], [0]
        waiting = [(0, sample)]
        while waiting:
            node, points = waiting.pop(0)
            groups = _k_means(points, BRANCHES, rng) if len(points) > leaf_rows else []
            if len(groups) < 2:
                continue
            self.first[node], self.n_children[node] = len(self.centres), len(groups)
            for group in groups:
                waiting.append((len(self.centres), group))
                self.centres.append(group.mean(0))
                self.first.append(0)
                self.n_children.append(0)
                self.parent.append(node)
                depth.append(depth[node] + 1)
        self.centres = np.array(self.centres)
        self.squares = (self.centres**2).sum(1)
        self.levels = [np.flatnonzero(np.array(depth) == i) for i in range(1, max(depth) + 1)]

    @property
    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.n_children) if not n]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf reached by way of the nearest centre at each level."""
        out, waiting = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            n, first = self.n_children[node], self.first[node]
            if not n:
                out[rows] = node
                continue
            near = np.argmin(self.squares[first : first + n] - 2 * points[rows] @ self.centres[first : first + n].T, 1)
            waiting += [(first + i, rows[near == i]) for i in range(n) if (near == i).any()]
        return out

    def visits(self, queries: np.ndarray, most: int) -> Iterator[list[int]]:
        """The leaves each query visits, best bin first."""
        for far in self.squares - 2 * queries @ self.centres.T:
            far, queue, out = far.tolist(), [(0.0, 0)], []
            while queue and len(out) < most:
                _, node = heapq.heappop(queue)
                n, first = self.n_children[node], self.first[node]
                if not n:
                    out.append(node)
                for child in range(first, first + n):
                    heapq.heappush(queue, (far[child], child))
            yield out

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, in the order of `leaves`, the largest distance on the way to it: best bin first comes to leaves in this order."""
        far, parent = self.squares - 2 * queries @ self.centres.T, np.array(self.parent)
        far[:, 0] = -np.inf
        for nodes in self.levels:
            far[:, nodes] = np.maximum(far[:, nodes], far[:, parent[nodes]])
        return far[:, self.leaves]

    def visited(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Whether a query visits a leaf, in the order of `leaves`: the first `most` best bin first, and those as near as the last of them."""
        far = self.reach(queries)
        return far <= np.partition(far, min(most, far.shape[1]) - 1, 1)[:, min(most, far.shape[1]) - 1, None]


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
        moved = np.array([points[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
    return [points[near == i] for i in range(len(centres)) if (near == i).any()]


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest norm, with the component that brings each to norm 1."""
    v = vectors / longest
    return np.concatenate([v, np.sqrt(np.maximum(0.0, 1.0 - (v**2).sum(1, keepdims=True)))], 1)


def _directions(queries: np.ndarray) -> np.ndarray:
    q = queries / np.abs(queries).max(1, keepdims=True)
    q /= np.sqrt((q**2).sum(1, keepdims=True))
    return np.concatenate([q, np.zeros((len(q), 1))], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; shorter ones are filled with zeros, which add nothing to an inner product."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def inner_products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of products in double precision, component after component; what overflows to no number counts as minus infinity."""
    out = np.zeros(len(one))
    with np.errstate(all="ignore"):
        for i in range(one.shape[1]):
            out += one[:, i] * two[:, i]
    return np.where(np.isnan(out), -np.inf, out)


def _kind(rows: DataFrame) -> str:
    """Type of the components: float where the table has floats, else double."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    return kind if kind == "float" else "double"


def usable(rows: DataFrame, is_query: Column | str | None = None) -> DataFrame:
    """vec_id, vector and key, which equal vectors share; without vectors that are null, zero, or hold null or non-finite components."""
    kind = _kind(rows)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    own = own if is_query is None else own.where(is_query)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + np.float32(0)  # null: no number; minus zero: zero
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad, some = (np.bincount(row, weights=x, minlength=len(sizes)) for x in (~np.isfinite(flat), flat != 0))
            good = (bad == 0) & (some > 0)
            values, sizes = flat[np.repeat(good, sizes)], sizes[good]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            wide = values.astype(np.float64).tobytes()
            keys = [hashlib.sha256(wide[8 * i : 8 * j]).digest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float32() if kind == "float" else pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), vectors, pa.array(keys, pa.binary())], ["vec_id", "vector", "key"])

    return own.mapInArrow(work, f"vec_id long, vector array<{kind}>, key binary")


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """One entry for equal vectors: key, vector and the k + 1 smallest ids (nulls last), all that can be among a query's k best rows."""
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x["vec_id"])
    return few.groupBy("key").agg(F.any_value("vector").alias("vector"), ids.alias("ids"))


def _measured(entries: DataFrame) -> tuple[int, int, float]:
    """Entries, the longest vector's components, and the largest norm."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = int(np.diff(batch.column(0).offsets.to_numpy()).max())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([width]), pa.array([float(_norms(_matrix(batch.column(0), width)).max())])], ["n", "width", "longest"])

    got = entries.select("vector").mapInArrow(work, "n long, width long, longest double").agg(F.sum("n"), F.max("width"), F.max("longest")).first()
    return got[0] or 0, got[1] or 0, got[2] or 0.0


def _norms(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(1, keepdims=True)
    with np.errstate(all="ignore"):
        return np.minimum(peak[:, 0] * np.sqrt(((vectors / peak) ** 2).sum(1)), 1e308)


def _dealt(entries: DataFrame, tree, width: int, longest: float, kind: str) -> DataFrame:
    """Entries with their leaf, then packed: a leaf's vectors in parts, matrices of at most CHUNK rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf_of(lifted(_matrix(batch.column(1), width), longest))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "key", "vector", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, part, own = None, 0, []

        def out() -> pa.RecordBatch:
            keys, matrix = b"".join(k for b in own for k in b.column(1).to_pylist()), np.concatenate([_matrix(b.column(2), width) for b in own])
            ids = pa.concat_arrays([b.column(3) for b in own])
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([part]), pa.array([len(matrix)]), pa.array([keys]), pa.array([matrix.astype(_TYPE[kind]).tobytes()]), ids], ["leaf", "part", "n", "keys", "matrix", "ids"])

        for batch in batches:
            leaves = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at < end and leaves[at] != leaf:
                    if own:
                        yield out()
                    leaf, part, own = int(leaves[at]), 0, []
                while at < end:
                    own.append(batch.slice(at, min(end - at, CHUNK - sum(b.num_rows for b in own))))
                    at += own[-1].num_rows
                    if sum(b.num_rows for b in own) == CHUNK:
                        yield out()
                        part, own = part + 1, []
        if own:
            yield out()

    dealt = entries.select("key", "vector", "ids").mapInArrow(deal, f"leaf long, key binary, vector array<{kind}>, ids array<long>")
    return dealt.repartition("leaf").sortWithinPartitions("leaf", "key").mapInArrow(pack, "leaf long, part long, n long, keys binary, matrix binary, ids array<array<long>>")


_TYPE = {"float": np.float32, "double": np.float64}


class _Entries:
    """Entries of some leaves, to be searched: vectors, keys, ids, and the parts of leaves that they come in."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, pa.ListArray]], width: int, kind: str):
        self.vectors = np.concatenate([np.frombuffer(matrix, _TYPE[kind]).reshape(-1, width) for _, _, matrix, _ in parts])
        self.keys = np.frombuffer(b"".join(keys for _, keys, _, _ in parts), np.uint64).reshape(-1, KEY // 8)
        lists = pa.concat_arrays([ids for *_, ids in parts])
        self.first, self.n_ids = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.value_lengths().to_numpy()
        flat = lists.flatten()
        self.ids, self.no_id = flat.fill_null(0).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum([len(keys) // KEY for _, keys, _, _ in parts]).tolist()
        self.parts = list(zip([0, *ends[:-1]], ends, (leaf for leaf, *_ in parts), strict=True))
        self.leaf = np.concatenate([np.full(b - a, leaf) for a, b, leaf in self.parts])
        self.longest = [float(_norms(self.vectors[a:b].astype(np.float64)).max()) for a, b, _ in self.parts]
        self.units = np.concatenate([(self.vectors[a:b] / x).astype(np.float32) for (a, b, _), x in zip(self.parts, self.longest, strict=True)])


def _best_of(row: np.ndarray, score: np.ndarray, no_id: np.ndarray, least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row's n best, row by row and best first, ties to the smaller id (null last); and the place of each in its row."""
    order = np.lexsort((least, no_id, -score, row))
    sizes = np.unique(row[order], return_counts=True)[1]
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[place < n], place[place < n]


def _searched(entries: _Entries, queries: np.ndarray, reached: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, score and entry of each query's n best in the leaves that it reaches (a column for each part; all, without).

    Products of directions in single precision leave out what cannot be among the n best found so far, by a margin over
    their rounding; the rest is scored exactly.
    """
    size = _norms(queries)
    peak = np.abs(queries).max(1, keepdims=True)
    units = ((queries / peak) / (size[:, None] / peak)).astype(np.float32)
    slack = (queries.shape[1] + 16) * 2.0**-22
    floor = np.full(len(queries), -np.inf)
    held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    waiting: list = []
    most = len(queries) * max(end - start for start, end, _ in entries.parts)
    products, over = np.empty(most, np.float32), np.empty(most, bool)  # used again: new ones cost more than the comparison

    def best() -> list[np.ndarray]:
        row, score, code = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
        first = entries.first[code]
        keep, place = _best_of(row, score, entries.no_id[first], entries.ids[first], n)
        last = keep[place == n - 1]
        floor[row[last]] = score[last]
        waiting.clear()
        return [row[keep], score[keep], code[keep]]

    for i, ((start, end, _), longest) in enumerate(zip(entries.parts, entries.longest, strict=True)):
        own = np.arange(len(queries)) if reached is None else np.flatnonzero(reached[:, i])
        if not len(own):
            continue
        shape, n_products = (len(own), end - start), len(own) * (end - start)
        near = np.matmul(units if len(own) == len(queries) else units[own], entries.units[start:end].T, out=products[:n_products].reshape(shape))
        with np.errstate(all="ignore"):
            limit = floor[own] / size[own] / longest - slack
            new = np.isneginf(floor[own])
            if end - start > n and new.any():
                limit[new] = np.partition(near[new], end - start - n, 1)[:, end - start - n] - 2 * slack
            limit[~(size[own] * longest < 1e300) | np.isnan(limit)] = -np.inf  # what overflows is scored in any case
        hit = np.flatnonzero(np.greater_equal(near, limit.astype(np.float32)[:, None], out=over[:n_products].reshape(shape)))
        for at in range(0, len(hit), SCORED):
            row, code = own[hit[at : at + SCORED] // (end - start)], start + hit[at : at + SCORED] % (end - start)
            score = inner_products(queries[row], entries.vectors[code].astype(np.float64))
            keep = ~(score < floor[row])
            waiting.append((row[keep], score[keep], code[keep]))
            if sum(len(x[0]) for x in waiting) > (HELD * n * len(queries) if not np.isneginf(floor).any() else n * len(queries) // 2):
                held = best()
    return tuple(best())


PARTIAL = "block long, asked binary, row array<int>, score array<double>, own array<boolean>, leaf array<long>, n_ids array<int>, ids array<long>"
FOUND = "query binary, leaves array<long>, hits array<struct<score:double,own:boolean,vec_id:long>>"


def _partial(block: int, entries: _Entries, queries: np.ndarray, keys: bytes, rows: np.ndarray, reached: np.ndarray | None, n: int) -> pa.RecordBatch:
    """What a block's queries, numbered `rows` in it, find in some entries: one row, keys of the queries with their numbers."""
    at, score, code = _searched(entries, queries, reached, n)
    own = (np.frombuffer(keys, np.uint64).reshape(-1, KEY // 8)[at] == entries.keys[code]).all(1)
    flat = np.repeat(entries.first[code], entries.n_ids[code]) + _counted(entries.n_ids[code])
    named = np.concatenate([rows.astype(np.uint64)[:, None], np.frombuffer(keys, np.uint64).reshape(-1, KEY // 8)], 1).tobytes()
    leaf = entries.leaf[code] if reached is None else np.zeros(len(code), np.int64)  # only calibration asks for it
    columns = [rows[at].astype(np.int32), score, own, leaf, entries.n_ids[code].astype(np.int32), pa.array(entries.ids[flat], mask=entries.no_id[flat])]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([named]), *lists], ["block", "asked", "row", "score", "own", "leaf", "n_ids", "ids"])


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _merged(partial: DataFrame, n: int) -> DataFrame:
    """Each query's n best entries and, of the rows these stand for, the n best. A task holds one block's at a time."""

    def best(found: list[list[np.ndarray]]) -> list[np.ndarray]:
        """row, score, own, leaf, n_ids of entries and ids, no_id of all their rows: those of the n best."""
        row, score, own, leaf, n_ids, ids, no_id = (np.concatenate(x) for x in zip(*found, strict=True))
        first = np.cumsum(n_ids) - n_ids
        keep, _ = _best_of(row, score, no_id[first], ids[first], n)
        flat = np.repeat(first[keep], n_ids[keep]) + _counted(n_ids[keep])
        return [row[keep], score[keep], own[keep], leaf[keep], n_ids[keep], ids[flat], no_id[flat]]

    def out(named: dict[int, bytes], found: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, score, own, leaf, n_ids, ids, no_id = best(found)
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        queries = np.unique(row)
        each, e_score, e_own = (np.repeat(x, n_ids) for x in (row, score, own))
        keep, _ = _best_of(each, e_score, no_id, ids, n)
        hits = pa.StructArray.from_arrays([pa.array(e_score[keep]), pa.array(e_own[keep]), pa.array(ids[keep], mask=no_id[keep])], ["score", "own", "vec_id"])
        columns = [pa.array([named[q] for q in queries.tolist()], pa.binary()), lists(_sizes(row[~own], queries), pa.array(leaf[~own])), lists(_sizes(each[keep], queries), hits)]
        return pa.RecordBatch.from_arrays(columns, ["query", "leaves", "hits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, named, found = None, {}, []
        for batch in batches:
            for i in range(batch.num_rows):
                block, asked, row, score, own, leaf, n_ids, ids = (c[i] for c in batch.columns)
                if block.as_py() != now and found:
                    yield out(named, found)
                    named, found = {}, []
                now, asked = block.as_py(), asked.as_py()
                step = KEY + 8
                named |= {int.from_bytes(asked[j : j + 8], sys.byteorder): asked[j + 8 : j + step] for j in range(0, len(asked), step)}
                plain = [x.values.to_numpy(zero_copy_only=False) for x in (row, score, own, leaf, n_ids)]
                found.append([*plain, ids.values.fill_null(0).to_numpy(), ids.values.is_null().to_numpy(zero_copy_only=False)])
                if len(found) == 16:
                    found = [best(found)]
        if found:
            yield out(named, found)

    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(work, FOUND)


def _sizes(row: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """How often each query is among the rows, which are in order."""
    return np.searchsorted(row, queries, "right") - np.searchsorted(row, queries, "left")


def _shard_rows(width: int, kind: str) -> int:
    return max(CHUNK, SHARD_BYTES // (width * np.dtype(_TYPE[kind]).itemsize))


def _exact(leaves: DataFrame, width: int, kind: str, keys: list[bytes], queries: np.ndarray, n: int) -> DataFrame:
    """The best entries of a bounded set of queries, one block, over all leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            return _partial(0, _Entries(parts, width, kind), queries, b"".join(keys), np.arange(len(keys)), None, n)

        for batch in batches:
            for i in range(batch.num_rows):
                leaf, size, own, matrix, ids = (batch.column(c)[i] for c in range(5))
                if parts and held + size.as_py() > _shard_rows(width, kind):
                    yield out()
                    parts, held = [], 0
                parts.append((leaf.as_py(), own.as_py(), matrix.as_py(), ids.values))
                held += size.as_py()
        if parts:
            yield out()

    return _merged(leaves.select("leaf", "n", "keys", "matrix", "ids").mapInArrow(work, PARTIAL), n)


def calibrated(tree: Tree, leaves: DataFrame, width: int, kind: str, sample: list, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit, and the recall that the sample's queries reach with them."""
    n_leaves = len(tree.leaves)
    if n_leaves == 1 or not sample:
        return n_leaves, 1.0
    keys, queries = [bytes(r.key) for r in sample], _filled([r.vector for r in sample], width)
    far = dict(zip(keys, tree.reach(_directions(queries)), strict=True))
    column = {leaf: i for i, leaf in enumerate(tree.leaves)}
    places: dict[bytes, np.ndarray] = {}
    for r in _exact(leaves, width, kind, keys, queries, k + 1).select("query", "leaves").collect():
        if r.leaves:
            own = far[bytes(r.query)]
            places[bytes(r.query)] = np.searchsorted(np.sort(own), own[[column[x] for x in r.leaves]], "left")
    for most in range(1, n_leaves + 1):
        got = np.array([np.mean(p < most) for p in places.values()] or [1.0])
        if got.mean() - 2 * got.std() / math.sqrt(len(got)) >= recall:
            break
    return most, float(got.mean())


def _sharded(leaves: DataFrame, rows: int) -> tuple[DataFrame, list[list[int]]]:
    """Parts of leaves with the shard that they belong to, of about so many rows; and each shard's leaves, by its parts in order."""
    spark, each, held = leaves.sparkSession, [], rows
    shards: list[list[int]] = []
    for leaf, part, n in sorted(map(tuple, leaves.select("leaf", "part", "n").collect())):
        if held + n > rows:
            shards.append([])
            held = 0
        shards[-1].append(leaf)
        each.append((leaf, part, len(shards) - 1))
        held += n
    found = spark.createDataFrame(each, "leaf long, part long, shard long")
    return leaves.join(broadcast_if_small(found, len(each)), ["leaf", "part"]), shards


def _filled(vectors: list, width: int) -> np.ndarray:
    return np.array([list(v) + [0.0] * (width - len(v)) for v in vectors], float).reshape(-1, width)


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column | str, k: int = 20, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) that is_query accepts, the k rows of largest inner product found.

    The row itself is no candidate; all others are, repeated rows and those without an id included. Nearest first, ties to
    the smaller vec_id (null last); all candidates if there are fewer than k. Scores are taken on the original vectors.
    Vectors that are null, zero, or hold null or non-finite components take no part; of vectors of unequal lengths the
    shorter counts as filled with zeros. A repeated query row is a query of its own. No rows in, none out; other columns are
    ignored.
    """
    scratch, kind = Scratch(spark), _kind(vectors)
    entries = scratch.keep(entries_of(usable(vectors), k), "entries")
    n, width, longest = _measured(entries)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = entries.where(chance < math.ceil((1 << 30) * min(1.0, TRAIN_ROWS / n))).select("key", "vector").limit(2 * TRAIN_ROWS).collect()
    sample.sort(key=lambda r: bytes(r.key))
    tree = Tree(lifted(_filled([r.vector for r in sample], width), longest), max(8, leaf_rows * len(sample) // n))
    del sample
    sent = spark.sparkContext.broadcast(tree)
    leaves = scratch.keep(_dealt(entries, sent, width, longest, kind), "leaves")
    scratch.drop("entries")
    asked = scratch.keep(usable(vectors, is_query), "asked")
    queries = scratch.keep(asked.groupBy("key").agg(F.any_value("vector").alias("vector")), "queries")
    n_queries = queries.count()
    few = queries.where(chance < math.ceil((1 << 30) * min(1.0, CALIBRATION_QUERIES / max(1, n_queries)))).limit(2 * CALIBRATION_QUERIES).collect()
    most, _ = calibrated(tree, leaves, width, kind, few, k, recall)
    parts, shards = _sharded(leaves, _shard_rows(width, kind))
    column = {leaf: i for i, leaf in enumerate(tree.leaves)}
    places = spark.sparkContext.broadcast([np.array([column[leaf] for leaf in own]) for own in shards])

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                keys, matrix = np.array(own.column(0).to_pylist(), "V32"), _matrix(own.column(1), width)
                visited = sent.value.visited(_directions(matrix), most)
                for shard, columns in enumerate(places.value):
                    rows = np.flatnonzero(visited[:, columns].any(1)).astype(np.int32)
                    if len(rows):
                        reached = np.packbits(visited[np.ix_(rows, columns)])
                        values = (keys[rows].tobytes(), matrix[rows].astype(_TYPE[kind]).tobytes(), rows.tobytes(), reached.tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block]), *(pa.array([x], pa.binary()) for x in values)], ["shard", "block", "keys", "matrix", "rows", "reached"])
                block += 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, entries = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, leaf, keys, matrix, ids, rows, reached = (batch.column(c)[i] for c in range(8))
                if shard.as_py() != now:
                    now, parts, entries = shard.as_py(), [], None
                if not block.is_valid:
                    parts.append((leaf.as_py(), keys.as_py(), matrix.as_py(), ids.values))
                    continue
                entries = entries or _Entries(parts, width, kind)
                rows, parts = np.frombuffer(rows.as_py(), np.int32), []
                to = np.unpackbits(np.frombuffer(reached.as_py(), np.uint8), count=len(rows) * len(entries.parts)).reshape(len(rows), -1).astype(bool)
                asked = np.frombuffer(matrix.as_py(), _TYPE[kind]).reshape(-1, width).astype(np.float64)
                yield _partial(block.as_py(), entries, asked, keys.as_py(), rows, to, k + 1)

    # a shard's leaves come first, in order, then the blocks of queries, one at a time
    dealt = queries.select("key", "vector").coalesce(max(1, math.ceil(n_queries / BLOCK))).mapInArrow(travel, "shard long, block long, keys binary, matrix binary, rows binary, reached binary")
    both = parts.unionByName(dealt, allowMissingColumns=True).select("shard", "block", "leaf", "part", "keys", "matrix", "ids", "rows", "reached")
    met = both.repartition("shard").sortWithinPartitions(F.col("shard"), F.col("block").asc_nulls_first(), "leaf", "part").drop("part")
    lists = _merged(met.mapInArrow(search, PARTIAL), k + 1)
    joined = asked.select(F.col("vec_id").alias("query_id"), "key").join(lists.drop("leaves"), F.col("key") == F.col("query"))
    self = F.expr("coalesce(array_position(transform(hits, h -> h.own and h.vec_id <=> query_id), true), 0)")
    rest = joined.withColumn("self", self).withColumn("hits", F.expr(f"slice(if(self > 0, filter(hits, (h, i) -> i + 1 <> self), hits), 1, {k})"))
    out = rest.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
