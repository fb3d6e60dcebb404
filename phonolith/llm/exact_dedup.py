"""Exact deduplication through a cuckoo-filter index over content digests.

The index is a table, sharded by digest. In a task, a shard is a cuckoo filter and, by the filter's own bucket numbers,
the full digests of its live keys. The filter alone answers most look-ups of new content; only a hit looks into its
content bucket, where it is verified; an insertion that finds no place doubles the filter and fills it again from the
stored keys. Deduplication builds such an index of a table's content; later content is looked up in it, inserted or
deleted, and only the shards touched are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import SPACE, Scratch, broadcast_if_small

SLOTS = 4
MAX_KICKS = 200


class CuckooShard:
    """A cuckoo filter of 16-bit fingerprints, and the live keys in buckets beside it. Small: one shard's keys."""

    def __init__(self, keys: int = 0):
        self.size = self.resizes = 0
        self._room(max(4, keys))

    def _room(self, keys: int) -> None:
        self.n = 1 << max(2, math.ceil(math.log2(keys / SLOTS / 0.8)))
        self.table: list[list[int]] = [[] for _ in range(self.n)]
        self.content: list[list[list]] = [[] for _ in range(self.n)]  # [digest, value] by the key's first bucket

    def _place(self, digest: str) -> tuple[int, int, int]:
        h = int(digest[-16:], 16)
        mark = (h & 0xFFFF) or 1
        one = (h >> 16) & (self.n - 1)
        return mark, one, one ^ (mark * 0x5BD1E995 & (self.n - 1))

    def _entry(self, digest: str) -> list | None:
        """The stored key; its content bucket is looked into only if the filter has a fingerprint like it."""
        mark, one, two = self._place(digest)
        if mark not in self.table[one] and mark not in self.table[two]:
            return None
        return next((x for x in self.content[one] if x[0] == digest), None)

    def maybe(self, digest: str) -> bool:
        """False: surely not live."""
        mark, one, two = self._place(digest)
        return mark in self.table[one] or mark in self.table[two]

    def find(self, digest: str) -> object | None:
        """The key's value; a filter hit is verified against the stored digests."""
        entry = self._entry(digest)
        return None if entry is None else entry[1]

    def insert(self, digest: str, value: object) -> None:
        entry = self._entry(digest)
        if entry is not None:
            entry[1] = value
            return
        self.size += 1
        self._store([digest, value])

    def _store(self, entry: list) -> None:
        mark, one, two = self._place(entry[0])
        self.content[one].append(entry)
        at = one if len(self.table[one]) < SLOTS else two
        for kick in range(MAX_KICKS):
            bucket = self.table[at]
            if len(bucket) < SLOTS:
                bucket.append(mark)
                return
            out = kick % SLOTS
            mark, bucket[out] = bucket[out], mark
            at ^= mark * 0x5BD1E995 & (self.n - 1)
        self.resizes += 1
        stored = list(self.entries())
        self._room(max(self.size, self.n * SLOTS))
        for x in stored:
            self._store(x)

    def entries(self) -> Iterator[list]:
        """[digest, value] of every live key."""
        for bucket in self.content:
            yield from bucket

    def delete(self, digest: str) -> bool:
        """Only a verified live key is taken out, so no other key's fingerprint can go."""
        entry = self._entry(digest)
        if entry is None:
            return False
        mark, one, two = self._place(digest)
        self.table[one if mark in self.table[one] else two].remove(mark)
        self.content[one].remove(entry)
        self.size -= 1
        return True


def digest_column(text: Column) -> Column:
    """Digest of a text without whitespace; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and n_chars (code points of the text) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_column(F.col("text").cast("string")).alias("text_sha256"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"))


def shard_of(n_shards: int):
    return F.pmod(F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


def _n_shards(rows: int, keys_per_shard: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / keys_per_shard)))


_KEYS = "shard int, text_sha256 string, keep_id long, keep_chars long, group_size long"
_COLUMNS = ("keep_id", "keep_chars", "group_size")


def _rows(table: pa.Table) -> Iterator[tuple[str, list]]:
    """Digests and [keep_id, keep_chars, group_size]; ids are Python's integers, null or exact."""
    return zip(table.column("text_sha256").to_pylist(), map(list, zip(*(table.column(c).to_pylist() for c in _COLUMNS), strict=True)), strict=True)


def _shard(live: pa.Table) -> CuckooShard:
    shard = CuckooShard(live.num_rows)
    for sha, value in _rows(live):
        shard.insert(sha, value)
    return shard


def _stored(shard: CuckooShard, number: int | None) -> pa.Table:
    entries = list(shard.entries())
    values = [[v[i] for _, v in entries] for i in range(3)]
    return pa.table([pa.array([number] * len(entries), pa.int32()), pa.array([k for k, _ in entries], pa.string()), *(pa.array(v, pa.int64()) for v in values)], names=["shard", "text_sha256", *_COLUMNS])


def _number(*tables: pa.Table) -> int | None:
    return next((t.column("shard")[0].as_py() for t in tables if t.num_rows), None)


def _built(entries: pa.Table) -> pa.Table:
    """A shard of the entries; a verified hit joins the group of the key it hits, and the group's best stays."""
    shard = CuckooShard(entries.num_rows)
    rank = lambda v: (v[1], v[0] is not None, -(v[0] or 0))
    for sha, value in _rows(entries):
        live = shard.find(sha)
        if live is None:
            shard.insert(sha, value)
        else:
            best = max(live, value, key=rank)
            live[:] = [best[0], best[1], live[2] + value[2]]
    return _stored(shard, _number(entries))


def entries_of(digested: DataFrame, n_shards: int, salts: int = 16) -> DataFrame:
    """What digests bring to an index: the best row of a digest and salt and their number.

    Rows of one digest are summed before they reach the index, so a digest with any share of all rows brings at most
    `salts` entries to its shard.
    """
    found = digested.groupBy("text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("back"))).alias("best")
    )
    return found.select(shard_of(n_shards).alias("shard"), "text_sha256", F.bitwise_not("best.back").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size")


def index_of(digested: DataFrame, n_shards: int) -> DataFrame:
    """The index of digests(docs): a row per distinct digest with the id and length of the row that stays and the group's size."""
    return entries_of(digested, n_shards).groupBy("shard").applyInArrow(_built, _KEYS)


def exact_dedup(spark: SparkSession, docs: DataFrame, keys_per_shard: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical without whitespace; null counts as empty. Of equal texts the one with the most
    code points stays, then the smallest doc_id; a null doc_id stays only if all are null. Rows that repeat a doc_id
    with equal text are one group and all marked kept. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(spark)
    own = scratch.keep(digests(docs), "digests")
    index = scratch.keep(index_of(own, _n_shards(own.count(), keys_per_shard)), "index")
    shared = index.where("group_size > 1").select("text_sha256", F.lit(True).alias("shared"), "keep_id", "group_size")
    joined = own.join(shared, "text_sha256", "left")
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay. Rows that repeat a doc_id and text become one."""
    scratch = Scratch(spark)
    found = exact_dedup(spark, docs)
    gone = scratch.keep(found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "gone")
    repeated = scratch.keep(found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_sha256"), "repeated")
    sha = digest_column(docs["text"])
    left = docs.join(broadcast_if_small(gone, gone.count(), 120), docs["doc_id"].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")
    times = repeated.count()
    if not times:
        return left
    same = left["doc_id"].eqNullSafe(repeated["doc_id"]) & (digest_column(left["text"]) == repeated["text_sha256"])
    twice = left.join(broadcast_if_small(repeated, times, 120), same, "left_semi")
    once = left.join(broadcast_if_small(repeated, times, 120), same, "left_anti")
    own = f"sha_{uuid.uuid4().hex}"
    return once.unionByName(twice.withColumn(own, digest_column(F.col("text"))).dropDuplicates(["doc_id", own]).drop(own))


# The index as a kept table: each change reads the new content's shards together with the live ones.


def build_index(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """The index of docs' content."""
    return index_of(digests(docs), n_shards)


def _change(index: DataFrame, docs: DataFrame, n_shards: int, schema: str, work) -> DataFrame:
    new = build_index(docs, n_shards)
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(work, schema)


def insert(index: DataFrame, docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """The index with the digests of docs live as well; a key that is live keeps its doc_id, and its group grows."""

    def work(live: pa.Table, new: pa.Table) -> pa.Table:
        shard = _shard(live)
        for sha, value in _rows(new):
            found = shard.find(sha)
            if found is None:
                shard.insert(sha, value)
            else:
                found[2] += value[2]
        return _stored(shard, _number(live, new))

    return _change(index, docs, n_shards, _KEYS, work)


def delete(index: DataFrame, docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """The index without the digests of docs."""

    def work(live: pa.Table, gone: pa.Table) -> pa.Table:
        shard = _shard(live)
        for sha in gone.column("text_sha256").to_pylist():
            shard.delete(sha)
        return _stored(shard, _number(live, gone))

    return _change(index, docs, n_shards, _KEYS, work)


def lookup(index: DataFrame, docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """doc_id, text_sha256, live_id for each row of docs; live_id null when its content isn't live.

    Each distinct digest is asked for once: the shard's filter answers most that aren't live, a hit is verified.
    """

    def work(live: pa.Table, asked: pa.Table) -> pa.Table:
        shard = _shard(live)
        found = [(k, v[0]) for k in asked.column("text_sha256").to_pylist() if (v := shard.find(k)) is not None]
        return pa.table([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.int64())], names=["text_sha256", "live_id"])

    live = _change(index, docs, n_shards, "text_sha256 string, live_id long", work)
    return digests(docs).select("doc_id", "text_sha256").join(live, "text_sha256", "left").select("doc_id", "text_sha256", "live_id")


def digest_of(text: str | None) -> str:
    """The same digest in Python, for tests and single look-ups."""
    return hashlib.sha256("".join(c for c in text or "" if c not in " \t\n\v\f\r").encode()).hexdigest()
