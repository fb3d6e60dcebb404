"""Smaller operators of reports: screening counts, retries, thresholds, refinements, samples and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac


def screening(cells: DataFrame, threshold: float) -> DataFrame:
    """Counters of a screening: requested, land, withheld, eligible and quiet cells per source."""
    land = F.col("land")
    withheld, known = land & (F.col("quality") == "withheld"), F.col("raw") > 0
    return cells.groupBy("source").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(land).alias("land"), F.count_if(withheld).alias("withheld"), F.count_if(land & ~withheld & known).alias("eligible"),
        F.count_if(land & ~withheld & known & (F.col("raw") <= threshold)).alias("quiet"),
    )


def retries(attempts: DataFrame) -> DataFrame:
    """Attempts and errors by kind, with the code found in the text. attempts: tile, message (null: success)."""
    code = F.regexp_extract("message", r"\b([45][0-9]{2})\b", 1)
    kind = F.when(F.col("message").isNull(), "success").when(code != "", F.concat(F.lit("http_"), code)).when(F.lower("message").contains("timeout"), "timeout").otherwise("other")
    return attempts.withColumn("kind", kind).groupBy("kind").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("tile").alias("tiles"))


def quadrant_minima(cells: DataFrame, row_mid: int, col_mid: int) -> DataFrame:
    """Reported levels of each quadrant of a source's extract: the least and how often it stands, quantiles, and how far the quadrants' minima lie apart."""
    quadrant = F.concat(F.when(F.col("row_i") < row_mid, "N").otherwise("S"), F.when(F.col("col_i") < col_mid, "W").otherwise("E"))
    low = cells.where("raw > 0").groupBy("source", quadrant.alias("quadrant")).agg(F.min("raw").alias("min_db"), F.count(F.lit(1)).alias("cells"), *[F.percentile("raw", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)])
    quarter = cells.where("raw > 0").groupBy("source", quadrant.alias("quadrant"), F.col("raw").alias("min_db")).agg(F.count(F.lit(1)).alias("at_min"))
    low = low.join(quarter, ["source", "quadrant", "min_db"])
    return low.withColumn("spread_db", F.max("min_db").over(W.partitionBy("source")) - F.min("min_db").over(W.partitionBy("source")))


def shift_stability(cells: DataFrame, step: int) -> DataFrame:
    """Share of cells whose class stays the same `step` cells to the east, west, south and north, per source."""
    own = cells.withColumn("class", ac.display_class(F.col("raw"), ac.zero_cutoff(F.col("source"), F.lit("Lden")))).select("source", "row_i", "col_i", "class")
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.lit(r).alias("r"), F.lit(c).alias("c")) for w, r, c in (("east", 0, step), ("west", 0, -step), ("south", step, 0), ("north", -step, 0))]))
    other = own.select("source", "row_i", "col_i", ways.alias("w"), F.col("class").alias("o")).select("source", (F.col("row_i") - F.col("w.r")).alias("row_i"), (F.col("col_i") - F.col("w.c")).alias("col_i"), "w.way", "o")
    return own.join(other, ["source", "row_i", "col_i"]).groupBy("source", "way").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("class") == F.col("o")).cast("double")).alias("same"))


def top_of_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def touched_squares(points: DataFrame, side: float, reach: float) -> DataFrame:
    """Squares of a lattice that the box around any point meets."""
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / side).cast("long"), F.floor((F.col(c) + reach) / side).cast("long"))
    return points.select(F.explode(span("x")).alias("i"), "y").select("i", F.explode(span("y")).alias("j")).distinct()


def set_identity(members: DataFrame, group: str, member: str) -> DataFrame:
    """An id of each group's set of members that does not depend on their order or repetition."""
    ids = F.sort_array(F.collect_set(F.col(member).cast("string")))
    return members.groupBy(group).agg(F.size(ids).alias("members"), F.substring(F.sha2(F.concat_ws(",", ids), 256), 1, 16).alias("set_id"))


def block_medians(cells: DataFrame, factor: int) -> DataFrame:
    """Median reported level of blocks."""
    block = [F.floor(F.col(c) / factor).cast("long").alias(c.replace("_i", "_b")) for c in ("row_i", "col_i")]
    return cells.where("raw > 0").groupBy("source", *block).agg(F.percentile("raw", F.lit(0.5)).alias("median_db"), F.count(F.lit(1)).alias("n"))


def speeds(roads: DataFrame, table: DataFrame) -> DataFrame:
    """Speed of each road and vehicle class: the national motorway one for motorways, else a stated reference, with the basis.

    roads: link_id, road_class, vehicle; table: vehicle, motorway_kmh (nullable).
    """
    motorway = F.col("road_class") == "motorway"
    out = roads.join(F.broadcast(table), "vehicle", "left")
    basis = F.when(motorway & F.col("motorway_kmh").isNotNull(), "national_motorway_transfer").when(motorway, "motorway_reference").otherwise("unknown_road_reference")
    speed = F.when(motorway, F.coalesce("motorway_kmh", F.lit(70.0))).otherwise(40.0)
    return out.select("link_id", "vehicle", speed.alias("speed_kmh"), basis.alias("basis"))


def transmission(hours: DataFrame, distances: list[float], by: Sequence[str] = ("period",)) -> DataFrame:
    """Traffic-weighted share of energy left after absorption, by distance and period, or also vehicle group and band. hours: those, weight, alpha (dB/km)."""
    grid = F.explode(F.array(*[F.lit(x) for x in distances]))
    own = hours.withColumn("distance", grid)
    left = ac.db_to_energy(-F.col("alpha") * F.col("distance") / 1000.0)
    return own.groupBy("distance", *by).agg((F.sum(F.col("weight") * left) / F.sum("weight")).alias("left"))


def outside_dropped(cells: DataFrame, inside: Column) -> DataFrame:
    """Cells without the no-data ones that lie outside a country; values there stay."""
    return cells.where(~((F.col("raw") == ac.NODATA) & ~inside))


def sections(parts: DataFrame, quiet_db: float) -> DataFrame:
    """Longest quiet and longest noisy stretch of each path. parts: path, seq, db, length."""
    order = W.partitionBy("path").orderBy("seq")
    own = parts.withColumn("quiet", F.col("db") < quiet_db)
    own = own.withColumn("turn", F.when(F.col("quiet") == F.lag("quiet").over(order), 0).otherwise(1)).withColumn("run", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = own.groupBy("path", "run", "quiet").agg(F.sum("length").alias("m"))
    return runs.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("quiet"), F.col("m"))), F.lit(0.0)).alias("quiet_m"), F.coalesce(F.max(F.when(~F.col("quiet"), F.col("m"))), F.lit(0.0)).alias("noisy_m"))


def surface_summary(pixels: DataFrame) -> DataFrame:
    """Heights of a building's pixels: percentiles, share that is valid, and the first reason to refuse it. pixels: building, dz (null: invalid)."""
    out = pixels.groupBy("building").agg(F.count(F.lit(1)).alias("pixels"), F.count("dz").alias("valid"), *[F.percentile("dz", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)], F.avg((F.col("dz") < 0).cast("double")).alias("negative"))
    share = F.col("valid") / F.col("pixels")
    reason = F.when(F.col("pixels") < 4, "too_few_pixels").when(share < 0.8, "too_few_valid").when(F.col("negative") > 0.1, "negative_heights").when(F.col("p90") - F.col("p10") > 30, "uneven").otherwise("usable")
    return out.withColumns({"valid_share": share, "reason": reason})
