"""Benchmark decontamination by MinHash containment search.

A long document holds a short test item when it has at least 75 % of the item's shingles. A MinHash of fixed length says
nothing about that (30 shingles within 20,000 are a Jaccard similarity of 0.001), so the sketches are scaled: items are
partitioned by size, an item's sketch is its smallest shingle hashes, one more than a document may lack in its partition,
and a document's sketch is all its hashes up to the largest that any item of a partition kept. The share of an item's
sketch found in a document's sketch estimates containment; a document that holds the item to 75 % lacks so few shingles
that a part of the sketch is there for sure, so asking for that part loses nothing. Candidates are verified on the
shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import SPACE, Scratch, broadcast_if_small

WORDS = 5
PERCENT = 75


def words(text: Column) -> Column:
    """Lower-cased words; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingles(w: Column, hashed: bool) -> Column:
    """Shingles of five words in order, as 64-bit hashes or as strings; a shorter text is one shingle."""
    one = F.xxhash64(F.concat_ws(" ", w)) if hashed else F.concat_ws(" ", w)
    starts = F.slice(w, 1, F.size(w) - WORDS + 1)
    run = lambda x, i: [x, *(F.get(w, i + k) for k in range(1, WORDS))]
    many = F.transform(starts, lambda x, i: F.xxhash64(*run(x, i)) if hashed else F.concat_ws(" ", *run(x, i)))
    return F.when(F.size(w) >= WORDS, many).when(F.size(w) > 0, F.array(one))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, n_item and distinct shingles of each item, as strings; items without words are left out."""
    split = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(shingles(F.col("w"), False)).alias("s"))
    return split.where("s is not null").select("item_id", F.size("s").cast("long").alias("n_item"), "s")


def _may_lack(n: Column) -> Column:
    """Shingles of n that a document may lack and still hold 75 %."""
    return (n - F.ceil(n * PERCENT / 100)).cast("int")


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, part, least, hash): for each item its smallest shingle hashes, as many as its size partition asks for.

    A partition holds the sizes from a power of two up to the next; what a document may lack never falls with the size,
    so the partition's bound serves all its items. least: hashes of the sketch that a document with 75 % has for sure.
    """
    hashed = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.sort_array(F.array_distinct(shingles(F.col("w"), True))).alias("h")).where("h is not null")
    part = F.floor(F.log2(F.size("h").cast("double"))).cast("int")
    kept = hashed.withColumn("part", part).withColumn("n", F.size("h")).withColumn("kept", F.slice("h", 1, _may_lack(F.pow(F.lit(2.0), F.col("part") + 1) - 1) + 1))
    return kept.select("item_id", "part", (F.size("kept") - _may_lack(F.col("n"))).alias("least"), F.explode("kept").alias("hash"))


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(text)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, n_item, n_shared, containment: each document and item it holds to at least 75 %.

    A null or blank text holds nothing and a blank item is never found. A document of fewer than five words holds only
    an item that is the same few words. Rows with the same doc_id and text are one; rows with a null doc_id are told
    apart by their text. Other columns are ignored.
    """
    scratch = Scratch(spark)
    of_items = scratch.keep(item_shingles(items).select("item_id", "n_item", F.explode("s").alias("shingle")), "items")
    sketch = scratch.keep(sketches(items), "sketch")
    n_sketch, upper = sketch.agg(F.count(F.lit(1)), F.max("hash")).first()
    own = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    grams = own.select("doc_id", "text_key", words(F.col("text")).alias("w")).select("doc_id", "text_key", F.explode(F.array_distinct(F.filter(shingles(F.col("w"), True), lambda h: h <= F.lit(upper)))).alias("hash"))
    met = grams.join(broadcast_if_small(sketch, n_sketch), "hash").groupBy("doc_id", "text_key", "item_id").agg(F.count(F.lit(1)).alias("found"), F.first("least").alias("least"))
    met = scratch.keep(met.where("found >= least").select("doc_id", "text_key", "item_id"), "candidates")
    who = met.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    texts = own.join(broadcast_if_small(who, who.count()), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    held = texts.select("doc_id", "text_key", words(F.col("text")).alias("w")).select("doc_id", "text_key", F.explode(F.array_distinct(shingles(F.col("w"), False))).alias("shingle"))
    n_items, letters = of_items.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.length("shingle")), F.lit(0.0))).first()
    found = held.join(broadcast_if_small(of_items, n_items, 64 + int(4 * letters)), "shingle").groupBy("doc_id", "text_key", "item_id").agg(F.first("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    return found.where(F.lit(100) * F.col("n_shared") >= F.lit(PERCENT) * F.col("n_item")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; all columns of docs stay."""
    scratch = Scratch(spark)
    hits = scratch.keep(contaminated(spark, docs, items).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct(), "hits")
    same = docs["doc_id"].eqNullSafe(hits["hit_id"]) & (text_key(docs["text"]) == hits["hit_key"])
    return docs.join(broadcast_if_small(hits, hits.count()), same, "left_anti")
