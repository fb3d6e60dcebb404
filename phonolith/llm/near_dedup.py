"""MinHash near-duplicate classes with sequential Bayesian verification.

Nodes are distinct shingle sets, so exact copies cost one node. Banded signatures propose pairs; a pair's signatures
are compared batch by batch and the pair is dropped as soon as the posterior that its similarity reaches the
threshold falls below a chosen miss probability; survivors are confirmed on their full sets.

No bucket becomes all pairs. First, a bucket's members are dealt into chunks, with a few hubs in each of them; a chunk
gives a forest of its survivors, at most a pair a member, and the links among these join most of what belongs together.
Then, in buckets that still hold several classes, the members outside the largest class (strays) meet all members of other
classes in cells that are bounded on both sides. A pair counts only in the first bucket that it shares. Members with a
survivor bring their full sets, and a cell gives at most one link a class: enough to join what its links join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolith.llm.common import Scratch, broadcast_if_small, mix, shingle_set
from phonolith.llm.components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-7
#: Members of a bucket that a task compares at once, and the shingles that they may have together.
CHUNK, WEIGHT = 512, 1 << 20
#: Groups of few rows are compared together, about so many rows at once.
SMALL = 64
#: Members that stand in all chunks of their bucket.
HUBS = 3

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(8).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each of the permutations; hashes must not be empty."""
    low = np.full(len(_MULTIPLIERS), np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 512):  # blocks that stay in the CPU's cache
        block = np.bitwise_xor(hashes[i : i + 512, None], _SHIFTS) * _MULTIPLIERS
        np.minimum(low, block.min(axis=0), out=low)
    return (low >> np.uint64(24)).astype(np.uint16)  # the smallest value's leading bits are all alike


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


_SKETCH = T.StructType().add("set_key", "binary").add("n_shingles", "long").add("sig", "binary").add("bands", T.ArrayType(T.LongType()))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of a signature: two sets share it only if they agree on the whole band."""
    packed = sig.astype("<u2").view("<u8")
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def _lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _sketch(texts: pa.Array) -> pa.Array:
    """Set keys, sizes, signatures and band buckets."""
    keys, sizes, sigs, bands, lens = [], [], [], [np.zeros(0, np.int64)], []
    for text in texts:
        hashes = shingle_set(text)
        keys.append(set_key(hashes))
        sizes.append(len(hashes))
        lens.append(BANDS if len(hashes) else 0)
        sig = signature(hashes) if len(hashes) else np.zeros(0, np.uint16)
        sigs.append(sig.tobytes())
        if len(hashes):
            bands.append(band_keys(sig))
    arrays = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), _lists(np.concatenate(bands), lens, pa.int64())]
    return pa.StructArray.from_arrays(arrays, _SKETCH.names)


_SETS = T.StructType().add("node", "binary").add("hashes", T.ArrayType(T.LongType()))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of texts whose set is the node asked for."""
    for batch in batches:
        keys, flat, sizes = [], [np.zeros(0, np.int64)], []
        for text, key in zip(batch.column("text"), batch.column("node"), strict=True):
            hashes = shingle_set(text)
            if set_key(hashes) == key.as_py():
                keys.append(key.as_py())
                flat.append(np.sort(hashes.view(np.int64)))
                sizes.append(len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(np.concatenate(flat), sizes, pa.int64())], names=["node", "hashes"])


def least_matches(n: int, threshold: float = PERCENT / 100, miss: float = MISS) -> int:
    """Fewest equal hashes of n at which the posterior P(similarity >= threshold), under a flat prior, is not below miss."""

    def above(m: int) -> float:
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return next(m for m in range(n + 1) if above(m) >= miss)


_LEAST = [(n, least_matches(n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def matches(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """Equal positions of pairs of signatures (rows of x and y), or -1 where a batch, or the sizes, ruled the pair out."""
    alive = np.flatnonzero(100 * np.minimum(size_x, size_y) >= PERCENT * np.maximum(size_x, size_y))
    same = np.zeros(len(alive), np.int64)
    for upto, least in _LEAST:
        same = same + (x[alive, upto - BATCH : upto] == y[alive, upto - BATCH : upto]).sum(axis=1)
        alive, same = alive[same >= least], same[same >= least]
    out = np.full(len(x), -1)
    out[alive] = same
    return out


_PAIR = T.StructType().add("a", "binary").add("b", "binary")


def _pairs(nodes: list[bytes], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    ordered = [(nodes[x], nodes[y]) if nodes[x] < nodes[y] else (nodes[y], nodes[x]) for x, y in zip(i, j, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ordered], pa.binary()), pa.array([y for _, y in ordered], pa.binary())], names=_PAIR.names)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys, as tables of whole groups with the groups' bounds; a group may run over a batch's end."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
        if held is None or not held.num_rows:
            continue
        columns = [held.column(k).to_numpy() for k in keys]
        turns = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        bounds = np.concatenate([[0], turns, [held.num_rows]])
        if batch is not None:  # the last group may go on
            bounds = bounds[:-1]
        if len(bounds) > 1:
            yield held.slice(0, bounds[-1]), bounds
            held = held.slice(bounds[-1])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _columns(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(rows.num_rows, BANDS * ROWS)
    return rows.column("node").to_pylist(), sigs, rows.column("n_shingles").to_numpy()


def _compared(i: np.ndarray, j: np.ndarray, sigs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Survivors among the pairs (i, j) and their equal positions."""
    out = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(i), 20_000):
        x, y = i[k : k + 20_000], j[k : k + 20_000]
        got = matches(sigs[x], sigs[y], sizes[x], sizes[y])
        at = got >= 0
        out.append((x[at], y[at], got[at]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


class Forest:
    """Classes of numbered things, joined two at a time."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[x] = y
        return x != y


def likeliest_forest(n: int, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of n things make a forest of the highest `same`; in rounds, each class's best pair first."""
    forest, chosen, left = Forest(n), [], np.arange(len(i))
    while len(left):
        of = np.fromiter(map(forest.top, range(n)), np.int64, n)
        left = left[of[i[left]] != of[j[left]]]
        order = left[np.lexsort((left, same[left]))]
        best = np.full(n, -1)
        best[of[i[order]]] = order  # the last one written is the best
        other = np.full(n, -1)
        other[of[j[order]]] = order
        better = (other >= 0) & ((best < 0) | (same[other] > same[best]) | ((same[other] == same[best]) & (other > best)))
        for k in np.unique(np.where(better, other, best)):
            if k >= 0 and forest.join(int(i[k]), int(j[k])):
                chosen.append(k)
    return np.array(chosen, np.int64)


def _within(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(hi - lo, 1)
    return lo + i, lo + j


_CHUNK = ("bucket", "chunk")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a forest of its survivors: at most a pair a member."""
    for rows, bounds in _whole_groups(batches, _CHUNK):
        nodes, sigs, sizes = _columns(rows)
        for lo, hi in _spans(bounds):
            pairs = [_within(a, b) for a, b in _groups(bounds, lo, hi)]
            i, j, same = _compared(*(np.concatenate(x) for x in zip(*pairs, strict=True)), sigs, sizes)
            at = likeliest_forest(hi - lo, i - lo, j - lo, same)
            yield _pairs(nodes, i[at], j[at])


def _spans(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of large groups and of runs of small ones."""
    start = int(bounds[0])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo > SMALL and start < lo:
            yield start, int(lo)
            start = int(lo)
        if hi - start > SMALL:
            yield start, int(hi)
            start = int(hi)
    if start < bounds[-1]:
        yield start, int(bounds[-1])


def _groups(bounds: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    inner = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi) + 1].tolist()
    return zip(inner[:-1], inner[1:], strict=True)


_CELL = ("bucket", "a", "b")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes], int, int, np.ndarray, np.ndarray]]:
    """Cells with their survivors (i, j) among members of different classes, which share no earlier bucket."""
    for rows, bounds in _whole_groups(batches, _CELL):
        nodes, sigs, sizes = _columns(rows)
        left, band = rows.column("left").to_numpy(), rows.column("band").to_numpy()
        diagonal = rows.column("a").to_numpy() == rows.column("b").to_numpy()
        _, of = np.unique(np.array(rows.column("root").to_pylist(), "S16"), return_inverse=True)
        for start, end in _spans(bounds):
            pairs = []
            for lo, hi in _groups(bounds, start, end):
                if diagonal[lo]:
                    i, j = _within(lo, hi)
                else:
                    s, m = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
                    i, j = np.repeat(s, len(m)), np.tile(m, len(s))
                apart = of[i] != of[j]
                pairs.append((i[apart], j[apart]))
            i, j, _ = _compared(*(np.concatenate(x) for x in zip(*pairs, strict=True)), sigs, sizes)
            shared = (sigs[i] == sigs[j]).reshape(len(i), BANDS, ROWS).all(axis=2)
            first = np.argmax(shared, axis=1) == band[i]
            yield rows, nodes, start, end, i[first], j[first]


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a survivor in their cell: the only ones whose full sets are asked for."""
    for rows, _, _, _, i, j in _cells(batches):
        yield from rows.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()


def _linked_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between classes that meet in a cell whose rows bring their full sets: a forest of the cell's classes."""
    for rows, nodes, start, end, i, j in _cells(batches):
        own = rows.slice(start, end - start)
        hashes = own.column("hashes").combine_chunks()
        flat, ends = hashes.flatten().to_numpy(), np.cumsum(hashes.value_lengths().to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        values, codes = np.unique(flat, return_inverse=True)
        _, of = np.unique(np.array(own.column("root").to_pylist(), "S16"), return_inverse=True)
        i, j, sizes = i - start, j - start, ends - starts
        classes, found = Forest(int(of.max(initial=-1)) + 1), []
        marked = np.zeros(len(values), bool)
        order = np.argsort(i, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(order) else []:
            x, ys = int(i[part[0]]), j[part]
            ys = ys[[classes.top(int(of[y])) != classes.top(int(of[x])) for y in ys]]
            if not len(ys):
                continue
            marked[codes[starts[x] : ends[x]]] = True
            both = np.array([int(marked[codes[starts[y] : ends[y]]].sum()) for y in ys])
            marked[codes[starts[x] : ends[x]]] = False
            for y in ys[100 * both >= PERCENT * (sizes[x] + sizes[ys] - both)]:
                if classes.join(int(of[x]), int(of[y])):
                    found.append((start + x, start + int(y)))
        yield _pairs(nodes, *np.array(found, np.int64).reshape(-1, 2).T)


def in_cells(mixed: DataFrame) -> DataFrame:
    """mixed's rows with a, b and left: the members of mixed buckets by cells, where each stray meets each other member once.

    Strays are dealt into a bucket's first chunks and members of its main class into the next; a cell is a chunk of
    strays (left) and a chunk of either kind, so neither side grows with the bucket. Cells a = b hold one chunk.
    """
    pieces = lambda n, weight: F.greatest(F.ceil(n / CHUNK), F.ceil(weight / WEIGHT)).cast("int")
    strays, mains = pieces(F.col("n") - F.col("most"), F.col("weight") - F.col("main_weight")), pieces(F.col("most"), F.col("main_weight"))
    stray, deal = F.col("root") != F.col("main"), F.xxhash64("node")
    dealt = mixed.withColumns({"strays": strays, "mains": mains, "stray": stray}).withColumn("own", F.when(F.col("stray"), F.pmod(deal, "strays")).otherwise(F.col("strays") + F.pmod(deal, "mains")).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("stray"), F.col("strays") + F.col("mains")).otherwise(F.col("strays")) - 1)
    met = dealt.withColumn("other", F.explode(other))
    return met.select("bucket", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("left"), "node", "root")


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    both = int((q[at] == p).sum())
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("hashes_a"), batch.column("hashes_b")
        keep = [similar(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Sets:
    """Shingle sets of the nodes asked for so far, each taken from one text."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, text: DataFrame):
        self.scratch, self.nodes, self.text = scratch, nodes, text
        self.parts: list[DataFrame] = []

    def of(self, asked: DataFrame, name: str) -> DataFrame:
        """(node, hashes) of asked(node), and of whatever was asked for before."""
        asked = asked.distinct()
        for part in self.parts:
            asked = asked.join(part.select("node"), "node", "left_anti")
        asked = self.scratch.keep(asked.join(self.nodes.select("node", F.col("doc_id").alias("own_id"), "text_key"), "node"), f"sets-asked-{name}")
        # by the text's hash as well: texts without an id, or with a repeated one, meet the sets of equal texts only
        own = self.text.join(broadcast_if_small(asked, asked.count()), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("text_key"))).select("node", "text")
        self.parts.append(self.scratch.keep(own.mapInArrow(_full_sets, _SETS).dropDuplicates(["node"]), f"sets-{name}"))
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.union(part)
        return out


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the distinct pairs whose full sets are similar enough; only the sets asked for are moved."""
    full = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    return pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirm, _PAIR)


def _chunked(members: DataFrame) -> DataFrame:
    """(bucket, chunk, node): members of each bucket by chunks, and hubs in all chunks of buckets that have several."""
    own = members.select("bucket", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", "chunks")
    hubs = own.where("chunks > 1").groupBy("bucket").agg(F.max("chunks").alias("chunks"), *[F.min_by("node", F.xxhash64("node", "bucket", F.lit(i))).alias(f"h{i}") for i in range(HUBS)])
    hubs = hubs.select("bucket", "chunks", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HUBS)]))).alias("node"))
    hubs = hubs.select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "chunks").where(F.pmod(F.xxhash64("node"), "chunks") != F.col("chunk"))
    return own.union(hubs).drop("chunks")


def near_components(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """Every row's sketch (doc_id, text_key, set_key, n_shingles) and every set's (node, doc_id, root), with the scratch they lie in."""
    scratch = Scratch(spark)
    sketch = F.arrow_udf(_sketch, _SKETCH)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.keep(text.select("doc_id", F.xxhash64("text").alias("text_key"), sketch("text").alias("s")).select("doc_id", "text_key", "s.*"), "sketches")
    first = sketches.where("n_shingles > 0").groupBy(F.col("set_key").alias("node"))
    nodes = scratch.keep(first.agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    in_bucket = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    members = scratch.keep(in_bucket.join(shared, "bucket").select("bucket", "band", "node", "n_shingles", chunks.alias("chunks")), "members")
    signed = lambda rows: rows.join(nodes.select("node", "sig", "n_shingles"), "node")
    dealt = lambda rows, keys: rows.repartition(*keys).sortWithinPartitions(*keys)
    close = scratch.keep(dealt(signed(_chunked(members)), _CHUNK).mapInArrow(_forests, _PAIR).distinct(), "close")
    sets = _Sets(scratch, nodes, text)
    links = scratch.keep(_linked(close, sets.of(close.select(F.col("a").alias("node")).union(close.select("b")), "close")), "links")
    roots = components(scratch, links, "roots")

    # buckets that still hold several classes: members outside the largest one against all members of other classes
    placed = _placed(members.select("bucket", "band", "node", "n_shingles"), roots)
    of_class = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    size = F.struct("n", "root", "weight")
    mixed = of_class.groupBy("bucket").agg(F.max(size).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    mixed = placed.drop("n_shingles").join(mixed.select("bucket", "n", "weight", F.col("main.n").alias("most"), F.col("main.root").alias("main"), F.col("main.weight").alias("main_weight")), "bucket")
    rows = signed(in_cells(mixed))
    rows = scratch.keep(dealt(rows, _CELL).mapInArrow(_surviving, rows.schema), "survivors")
    scratch.drop("members", "close")
    full = dealt(rows.join(sets.of(rows.select("node"), "survivors"), "node"), _CELL)
    more = scratch.keep(full.mapInArrow(_linked_across, _PAIR).distinct(), "more-links")
    if not more.isEmpty():  # what is joined already stays joined: a node and its root are linked
        roots = components(scratch, more.union(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))), "all-roots")
    placed = _placed(nodes.select("node", "doc_id"), roots)
    return sketches.select("doc_id", "text_key", "set_key", "n_shingles"), placed, scratch


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of the class that their node is in, itself if it has no link."""
    return rows.join(broadcast_if_small(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of docs.

    Documents are linked when their sets of 5-word shingles (A-Z folded; a shorter text is one shingle) have a Jaccard
    similarity of at least 0.75. component_id is the smallest doc_id reachable. A null, empty or blank text has no
    shingles and is linked with nothing. Rows with a null doc_id link like others and never name a component unless
    all its ids are null. Rows that repeat a doc_id each get their own row. Other columns are ignored.
    """
    sketches, placed, scratch = near_components(spark, docs)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = scratch.keep(placed.join(smallest, "root").select(F.col("node").alias("set_key"), "component_id"), "names")
    joined = sketches.where("n_shingles > 0").join(names, "set_key").drop("set_key")
    blank = sketches.where("n_shingles = 0").drop("set_key").withColumn("component_id", F.col("doc_id"))
    return joined.union(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; all columns stay.

    Rows that repeat the doc_id that stays, with a text of the same group, stay with it.
    """
    scratch = Scratch(spark)
    gone = scratch.keep(near_dedup(spark, docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"])
    return docs.join(broadcast_if_small(gone, gone.count()), same, "left_anti")
