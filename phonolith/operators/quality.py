"""Checks of inventories, layouts and registers; each returns the rows or counts that a report shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unexpected or found more than once."""
    a = expected.select(key).distinct().withColumn("expected", F.lit(True))
    b = found.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("times") > 1, "duplicate")
    return a.join(b, key, "full_outer").select(key, fault.alias("fault"), F.coalesce("times", F.lit(0)).cast("long").alias("times")).where("fault is not null")


def layout(tiles: DataFrame) -> DataFrame:
    """Shared edges between neighbours in a grid of tiles: sound, gap or overlap, by direction.

    tiles: row_i, col_i, minx, miny, maxx, maxy (north first).
    """
    a = tiles.select("row_i", "col_i", F.col("maxx").alias("a_maxx"), F.col("miny").alias("a_miny"))
    right = tiles.select("row_i", (F.col("col_i") - 1).alias("col_i"), F.col("minx").alias("b"))
    below = tiles.select((F.col("row_i") - 1).alias("row_i"), "col_i", F.col("maxy").alias("b"))
    across = a.join(right, ["row_i", "col_i"]).select(F.lit("horizontal").alias("direction"), (F.col("b") - F.col("a_maxx")).alias("gap"))
    down = a.join(below, ["row_i", "col_i"]).select(F.lit("vertical").alias("direction"), (F.col("a_miny") - F.col("b")).alias("gap"))
    return across.union(down).groupBy("direction").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("gap") == 0).alias("sound"), F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"))


def overlapping(boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that overlap, through buckets; a pair is taken in the bucket of its overlap's lower left corner only."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))
    held = boxes.withColumn("bx", F.explode(span("minx", "maxx"))).withColumn("by", F.explode(span("miny", "maxy")))
    other = held.select("bx", "by", *[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    x, y = F.greatest("minx", "o_minx"), F.greatest("miny", "o_miny")
    meet = (F.least("maxx", "o_maxx") > x) & (F.least("maxy", "o_maxy") > y)
    here = (F.floor(x / size) == F.col("bx")) & (F.floor(y / size) == F.col("by"))
    return held.join(other, ["bx", "by"]).where((F.col("id") < F.col("o_id")) & meet & here).select("id", "o_id")


def register(recorded: DataFrame, configured: DataFrame) -> DataFrame:
    """Per source and field: whether recorded and configured values agree, conflict, or only one is known."""
    a = recorded.groupBy("source", "field").agg(F.sort_array(F.collect_set("value")).alias("recorded"))
    b = configured.groupBy("source", "field").agg(F.sort_array(F.collect_set("value")).alias("configured"))
    state = (
        F.when(F.col("recorded").isNull(), "configured_only").when(F.col("configured").isNull(), "recorded").when(F.size("recorded") > 1, "conflicting")
        .when(F.col("recorded") == F.col("configured"), "recorded").otherwise("conflicting")
    )
    return a.join(b, ["source", "field"], "full_outer").select("source", "field", F.coalesce(F.size("recorded"), F.lit(0)).alias("values"), state.alias("state"))


def contradictions(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys on one side only, or whose columns differ; rows that agree are left out."""
    digest = lambda: F.sha2(F.to_json(F.struct(*columns)), 256)
    a, b = left.select(key, digest().alias("a")), right.select(key, digest().alias("b"))
    reason = F.when(F.col("a").isNull(), "unknown").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "contradicting")
    return a.join(b, key, "full_outer").select(key, reason.alias("reason")).where("reason is not null")


def varies(observed: DataFrame) -> DataFrame:
    """Distinct values of each source and field over tiles, and whether they vary."""
    out = observed.groupBy("source", "field").agg(F.countDistinct("value").alias("values"), F.countDistinct("tile").alias("tiles"))
    return out.withColumn("varies", F.col("values") > 1)


def fingerprint(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of the rows of each group: counts and sums of row hashes, so no group is gathered in one place."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    out = df.withColumn("_h", row).groupBy(by).agg(F.count(F.lit(1)).alias("n"), part(0).alias("p0"), part(1).alias("p1"), part(2).alias("p2"))
    return out.select(by, "n", F.substring(F.sha2(F.concat_ws(":", "n", "p0", "p1", "p2"), 256), 1, 16).alias("digest"))
