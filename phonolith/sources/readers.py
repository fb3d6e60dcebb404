"""Readers with fixed schemas: nothing is inferred, and a row that does not fit is an error or a counted reject."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("pedal_cycles", "two_wheeled_motor_vehicles", "cars_and_taxis", "buses_and_coaches", "lgvs", "all_hgvs")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file or folder of text columns whose header must be exactly `columns`."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def number(text: Column) -> Column:
    """A finite number, or null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def annual_flows(raw: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Count points of exactly one year with nullable vehicle categories, and the rejected rows by reason.

    raw: text columns count_point_id, year, road_type, road_name, easting, northing, all_motor_vehicles and CATEGORIES.
    An identity that occurs twice among the kept rows is an error.
    """
    own = raw.withColumns({"flow": number(F.col("all_motor_vehicles")), "x": number(F.col("easting")), "y": number(F.col("northing"))})
    reason = (
        F.when(F.col("year").try_cast("int") != year, "other_year").when(F.col("year").try_cast("int").isNull(), "no_year").when(F.coalesce(F.trim("count_point_id"), F.lit("")) == "", "no_identity")
        .when(F.col("flow").isNull() | (F.col("flow") <= 0), "no_flow").when(F.col("x").isNull() | F.col("y").isNull(), "no_position")
    )
    own = own.withColumn("reason", reason)
    categories = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), number(F.col(c)))])
    kept = own.where("reason is null").select("count_point_id", F.lit(year).alias("year"), "road_type", "road_name", "flow", "x", "y", categories.alias("categories"))
    times = kept.groupBy("count_point_id").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.join(times, "count_point_id").withColumn("count_point_id", F.when(F.col("n") == 1, F.col("count_point_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate count point "), F.col("count_point_id"))))).drop("n")
    return kept, own.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def hour_index(raw: DataFrame) -> DataFrame:
    """(vehicle_group, weekday, hour, index) from one row per group and hour with a column for each weekday; 24 hours each or an error."""
    long = raw.select("vehicle_group", F.col("hour").cast("int").alias("hour"), *DAYS).unpivot(["vehicle_group", "hour"], list(DAYS), "weekday", "value")
    whole = long.groupBy("vehicle_group").agg(F.countDistinct("hour").alias("hours"), F.count_if(number(F.col("value")).isNull()).alias("missing"))
    whole = whole.select("vehicle_group", F.when((F.col("hours") == 24) & (F.col("missing") == 0), True).otherwise(F.raise_error(F.concat(F.lit("incomplete profile "), F.col("vehicle_group")))).alias("ok"))
    return long.join(whole, "vehicle_group").where("ok").select("vehicle_group", "weekday", "hour", number(F.col("value")).alias("index"))


def weather(lines: DataFrame) -> DataFrame:
    """Fixed-width surface reports (one text column, value) as typed columns; a value without a passing quality code is null."""
    cut = lambda a, n: F.substring("value", a + 1, n)
    good = lambda at: cut(at, 1).isin("1", "5")

    def field(at: int, n: int, missing: str, scale: float, code: int, low: float, high: float) -> Column:
        value = cut(at, n).try_cast("int") / F.lit(scale)
        return F.when((cut(at, n) != missing) & good(code) & value.between(low, high), value)

    pressure = F.regexp_extract("value", r"^.{105}(?:(?!REM|EQD).)*?MA1[0-9]{5}[0-9A-Z]([0-9]{5})([15])", 1)
    station = F.when((pressure != "") & (pressure != "99999"), pressure.try_cast("int") / F.lit(100.0))
    direction = F.when(~cut(64, 1).isin("C", "V", "9"), field(60, 3, "999", 1, 63, 1, 360))
    return lines.where(F.length("value") >= 105).select(
        cut(4, 11).alias("station"), F.try_to_timestamp(cut(15, 12), F.lit("yyyyMMddHHmm")).alias("ts"), cut(41, 5).alias("report_type"), field(87, 5, "+9999", 10, 92, -93.2, 61.8).alias("temperature_c"),
        field(93, 5, "+9999", 10, 98, -98.2, 36.8).alias("dewpoint_c"), field(65, 4, "9999", 10, 69, 0, 90).alias("wind_m_s"), direction.alias("wind_from"),
        field(99, 5, "99999", 100, 104, 86, 110).alias("sea_level_kpa"), F.when(station.between(45, 109), station).alias("station_kpa"),
    )


def strict_json(text: Column) -> Column:
    """A JSON text as a VARIANT; a key that repeats within an object, or text that is no JSON, is an error."""
    return F.parse_json(text)


def sorted_json(text: Column) -> Column:
    """The same JSON with the keys of every object in order and no spaces: equal for equal content, so that it can be hashed."""
    return F.to_json(strict_json(text))


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(tile, band, status, sha256) of manifests: see identified_manifests."""
    return identified_manifests(spark, path, lines).drop("digest")


def identified_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(tile, band, status, sha256, digest) from nested JSON manifests {tiles: {id: {bands: {name: {status, sha256}}}}}.

    A file is one manifest (lines: a line is). Repeated keys are an error, not the last one's win; digest is of the whole
    manifest, whatever the order of its keys. A manifest without tiles is an error.
    """
    schema = "tiles map<string, struct<bands: map<string, struct<status: string, sha256: string>>>>"
    text = spark.read.text(path, wholetext=not lines).where("trim(value) <> ''").select(sorted_json(F.col("value")).alias("whole"))
    read = text.select(F.sha2("whole", 256).alias("digest"), F.from_json("whole", schema, {"mode": "FAILFAST"}).alias("m"))
    read = read.select("digest", F.when(F.col("m.tiles").isNotNull(), F.col("m.tiles")).otherwise(F.raise_error(F.lit("a manifest without tiles"))).alias("tiles"))
    tiles = read.select("digest", F.explode("tiles").alias("tile", "t"))
    return tiles.select("digest", "tile", F.explode("t.bands").alias("band", "b")).select("tile", "band", "b.status", "b.sha256", "digest")


def cells(tiles: DataFrame) -> DataFrame:
    """Cells of dense tiles(tile, source, west, top, n_cols, values, valid): row, column, centre and value (masked: -96)."""
    out = tiles.select("tile", "source", "west", "top", "n_cols", "valid", F.posexplode("values").alias("pos", "value"))
    row, col = F.floor(F.col("pos") / F.col("n_cols")).cast("long"), (F.col("pos") % F.col("n_cols")).cast("long")
    raw = F.when(F.get("valid", F.col("pos")), F.col("value").cast("double")).otherwise(-96.0)
    return out.select("tile", "source", row.alias("row_i"), col.alias("col_i"), (F.col("west") + (col + 0.5) * 10).alias("easting"), (F.col("top") - (row + 0.5) * 10).alias("northing"), raw.alias("raw"))


def grid(spark: SparkSession, box: tuple[float, float, float, float], side: float) -> DataFrame:
    """Tiles over a box snapped outward, north to south and west to east; the last row and column are clipped to it."""
    w, s, e, n = math.floor(box[0] / 100) * 100, math.floor(box[1] / 100) * 100, math.ceil(box[2] / 100) * 100, math.ceil(box[3] / 100) * 100
    cols, rows = -int(-(e - w) // side), -int(-(n - s) // side)
    out = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row_i"), F.pmod("id", F.lit(cols)).alias("col_i"))
    return out.select("row_i", "col_i", (w + F.col("col_i") * side).alias("minx"), F.greatest(F.lit(s), n - (F.col("row_i") + 1) * side).alias("miny"), F.least(F.lit(e), w + (F.col("col_i") + 1) * side).alias("maxx"), (n - F.col("row_i") * side).alias("maxy"))


def in_window(table: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose centre lies in west <= x < east, south < y <= north; plain comparisons, so files are pruned by their ranges."""
    return table.where((F.col("easting") >= west) & (F.col("easting") < east) & (F.col("northing") > south) & (F.col("northing") <= north))
