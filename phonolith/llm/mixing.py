"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a line of words, its documents in hashed order; the line is cut into blocks of equal size and read up
to three times. The schedule has one slot for each block that the mix takes. Slot times are van der Corput points: the
cells of the cumulative quotas are visited in bit-reversed order, so any stretch of the schedule holds every source in
nearly its target share, and each source gets exactly its quota. Slots are ranked per source in time order and joined
to the source's blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.llm.common import WORD, Scratch

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCK = 256
#: One row per source goes through the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Rows of a group that one window sorts, about; the number of groups follows the number of rows.
RUN = 2048


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST_PASSES) -> list[float]:
    """The total of sizes shared by weight; a share above `most` times its size stops there and the rest is shared anew."""
    share, rest = {}, sum(sizes)
    while len(share) < len(sizes):
        left = [i for i in range(len(sizes)) if i not in share]
        weight = sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] > most * sizes[i] * weight]
        if not over:
            share |= {i: rest * weights[i] / weight for i in left}
        for i in over:
            share[i] = float(most * sizes[i])
            rest -= most * sizes[i]
    return [share[i] for i in range(len(sizes))]


def _bits(n: int) -> int:
    return max(0, n - 1).bit_length()


def running(df: DataFrame, group: str, order: list[str], key: Column, key_bits: int, value: Column, rows: int) -> DataFrame:
    """df with `before`: the sum of value over earlier rows of the group, and `nth`, its place in its run.

    A group of any size is cut by the leading bits of key into runs of about RUN rows; sums of runs are carried over.
    """
    bits = min(key_bits, _bits(rows // RUN + 1))
    cut = df.withColumn("run", F.shiftright(key, key_bits - bits)).withColumn("_v", value)
    sums = cut.groupBy(group, "run").agg(F.sum("_v").alias("_sum"))
    carried = sums.withColumn("_from", F.sum("_sum").over(W.partitionBy(group).orderBy("run")) - F.col("_sum")).drop("_sum")
    within = W.partitionBy(group, "run").orderBy(*order)
    out = cut.join(carried, [group, "run"])
    before = F.col("_from") + F.sum("_v").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_v")
    return out.withColumn("before", before).withColumn("nth", F.row_number().over(within)).drop("_v", "_from")


def schedule(spark: SparkSession, quotas: Sequence[int]) -> DataFrame:
    """(sid, block, slot): slot times of each source's blocks; quotas: blocks taken of each source."""
    n = sum(quotas)
    bits = _bits(n)
    cell = 10
    starts = [sum(quotas[:i]) for i in range(len(quotas))] if len(quotas) < 1000 else _cumulative(quotas)
    own = [(i, a, a + q) for i, (a, q) in enumerate(zip(starts, quotas, strict=True)) if q]
    spans = spark.createDataFrame(own, "sid int, lo long, hi long")
    for level in (2 * cell, cell):  # in two steps, so no array is as long as a source has cells
        spans = spans.select("sid", F.explode(F.sequence(F.shiftright("lo", level), F.shiftright(F.col("hi") - 1, level))).alias("cell"), "lo", "hi")
        spans = spans.select("sid", "cell", F.greatest("lo", F.shiftleft("cell", level)).alias("lo"), F.least("hi", F.shiftleft(F.col("cell") + 1, level)).alias("hi"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("id"), max(1, bits), "0")), 2, 10).cast("long")
    points = spark.range(n).select(F.col("id").alias("point"), reverse.alias("slot"), F.shiftright("id", cell).alias("cell"))
    placed = points.join(spans, "cell").where("point >= lo and point < hi").select("sid", "slot")
    ranked = running(placed, "sid", ["slot"], F.col("slot"), bits, F.lit(1), n)
    return ranked.select("sid", F.col("before").cast("long").alias("block"), "slot")


def _cumulative(quotas: Sequence[int]) -> list[int]:
    out, at = [], 0
    for q in quotas:
        out.append(at)
        at += q
    return out


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The documents with their part in the mix, and the pieces of the schedule.

    Documents: doc_id, size, source_size, target, taken, source; pieces: slot, source id, block, doc_id, from_word, words.
    Sources go by code point, null last; null text has no words; a document without words is never taken. A null doc_id
    and repeated rows are rows like others. An empty table gives empty results. Other columns are ignored.
    """
    scratch = Scratch(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    share = targets([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))])
    words = [int(t + 0.5) for t in share]
    quotas = [-(-t // block) for t in words]
    rows = sum(r["rows"] for r in totals)
    plan = spark.createDataFrame(
        [(i, r.source, r["size"], t, w) for i, (r, t, w) in enumerate(zip(totals, share, words, strict=True))],
        "sid int, in_source string, source_size long, target double, quota_words long",
    )
    own = sized.join(plan, F.col("source").eqNullSafe(F.col("in_source"))).drop("in_source")
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    own = own.withColumn("turn", order).withColumn("lead", F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"))
    lined = scratch.keep(running(own, "sid", ["turn", "doc_id", "size"], F.col("lead"), 32, F.col("size"), rows).drop("turn", "lead"), "lined")
    turns = lined.where("size > 0").withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    lo = F.col("again") * F.col("source_size") + F.col("before")
    turns = turns.withColumn("lo", lo).where("lo < quota_words").withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota_words")))
    cut = turns.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    first, last = F.greatest(F.col("lo"), F.col("block") * block), F.least(F.col("hi"), (F.col("block") + 1) * block)
    cut = cut.select("sid", "run", "nth", "block", "doc_id", (first - F.col("lo")).alias("from_word"), (last - first).alias("words"))
    pieces = cut.join(schedule(spark, quotas), ["sid", "block"]).select("slot", "sid", "block", "run", "nth", "doc_id", "from_word", "words")
    taken = pieces.groupBy("sid", "run", "nth").agg(F.sum("words").alias("words"))
    # (sid, run, nth) names a row of `lined`, as that table is written once
    out = lined.join(taken, ["sid", "run", "nth"], "left")
    out = out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source")
    return out, pieces.drop("run", "nth")
