"""Emission spectra of roads and tables about the scene around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac

# Octave bands in Hz and coefficients of rolling (AR, BR) and propulsion (AP, BP) power per vehicle
# category, Delegated Directive (EU) 2021/1226, Appendix F.
BANDS = (63, 125, 250, 500, 1000, 2000, 4000, 8000)
COEFFICIENTS = {
    "1": ([83.1, 89.2, 87.7, 93.1, 100.1, 96.7, 86.8, 76.2], [30.0, 41.5, 38.9, 25.7, 32.5, 37.2, 39.0, 40.0], [97.9, 92.5, 90.7, 87.2, 84.7, 88.0, 84.4, 77.1], [-1.3, 7.2, 7.7, 8.0, 8.0, 8.0, 8.0, 8.0]),
    "2": ([88.7, 93.2, 95.7, 100.9, 101.7, 95.1, 87.8, 83.6], [30.0, 35.8, 32.6, 23.8, 30.1, 36.2, 38.3, 40.1], [105.5, 100.2, 100.5, 98.7, 101.0, 97.8, 91.2, 85.0], [-1.9, 4.7, 6.4, 6.5, 6.5, 6.5, 6.5, 6.5]),
    "3": ([91.7, 96.2, 98.2, 104.9, 105.1, 98.5, 91.1, 85.6], [30.0, 33.5, 31.3, 25.4, 31.8, 37.1, 38.6, 40.6], [108.8, 104.2, 103.5, 102.9, 102.6, 98.5, 93.8, 87.5], [0.0, 3.0, 4.6, 5.0, 5.0, 5.0, 5.0, 5.0]),
    "4a": (None, None, [93.0, 93.0, 93.5, 95.3, 97.2, 100.4, 95.8, 90.9], [4.2, 7.4, 9.8, 11.6, 15.7, 18.9, 20.3, 20.6]),
    "4b": (None, None, [99.9, 101.9, 96.7, 94.4, 95.2, 94.7, 92.1, 88.6], [3.2, 5.9, 11.9, 11.6, 11.5, 12.6, 11.1, 12.0]),
}
A_WEIGHT = (-26.2, -16.1, -8.6, -3.2, 0.0, 1.2, 1.0, -1.1)


def coefficients(spark: SparkSession) -> DataFrame:
    """(category, band, ar, br, ap, bp); no rolling part for two-wheelers."""
    rows = [(c, b, ar[i] if ar else None, br[i] if br else None, ap[i], bp[i]) for c, (ar, br, ap, bp) in COEFFICIENTS.items() for i, b in enumerate(BANDS)]
    return spark.createDataFrame(rows, "category string, band int, ar double, br double, ap double, bp double")


def vehicle_power(flows: DataFrame) -> DataFrame:
    """Power of one vehicle in each band on the reference surface: flows(category, speed_kmh 20-130) joined to the coefficients."""
    v = F.col("speed_kmh")
    own = flows.join(F.broadcast(coefficients(flows.sparkSession)), "category")
    propulsion = ac.db_to_energy(F.col("ap") + F.col("bp") * (v - 70.0) / 70.0)
    rolling = F.when(F.col("ar").isNotNull(), ac.db_to_energy(F.col("ar") + F.col("br") * F.log10(v / 70.0)))
    return own.withColumn("power", F.when(v.between(20, 130), propulsion + F.coalesce(rolling, F.lit(0.0)))).drop("ar", "br", "ap", "bp")


def spectra(flows: DataFrame) -> DataFrame:
    """Source power per metre of each road, period and band; a road with an unknown flow or speed is withheld (null).

    flows: road, period, category, per_hour, speed_kmh.
    """
    part = F.col("power") * F.col("per_hour") / (1000.0 * F.col("speed_kmh"))
    out = vehicle_power(flows).withColumn("part", part).groupBy("road", "period", "band").agg(F.sum("part").alias("power"), F.count_if(F.col("part").isNull()).alias("unknown"))
    withheld = F.sum("unknown").over(W.partitionBy("road")) > 0
    return out.withColumn("power", F.when(~withheld, F.col("power"))).drop("unknown")


def den_levels(by_period: DataFrame) -> DataFrame:
    """A-weighted level of each road's day-evening-night power, (12 d + 4 10^0.5 e + 80 n) / 24."""
    weights = F.when(F.col("period") == "day", 12.0).when(F.col("period") == "evening", 4 * 10.0**0.5).otherwise(80.0) / 24
    a = F.element_at(F.create_map(*[x for b, w in zip(BANDS, A_WEIGHT, strict=True) for x in (F.lit(b), F.lit(w))]), F.col("band"))
    return by_period.groupBy("road").agg(F.sum(F.col("power") * weights * ac.db_to_energy(a)).alias("e"), F.count_if(F.col("power").isNull()).alias("unknown")).select("road", F.when(F.col("unknown") == 0, ac.energy_to_db(F.col("e"))).alias("den_db"))


def case_differences(levels: DataFrame) -> DataFrame:
    """Each case against the anchor: range and percentiles of the difference over roads. levels: road, case_id, db."""
    anchor = levels.where("case_id = 'anchor'").select("road", F.col("db").alias("anchor_db"))
    d = levels.join(anchor, "road").withColumn("d", F.col("db") - F.col("anchor_db"))
    return d.groupBy("case_id").agg(F.count("d").alias("roads"), F.min("d").alias("min_d"), F.percentile("d", F.lit(0.1)).alias("p10"), F.percentile("d", F.lit(0.5)).alias("p50"), F.percentile("d", F.lit(0.9)).alias("p90"), F.max("d").alias("max_d"))


def case_spread(levels: DataFrame) -> DataFrame:
    """Largest less smallest case of each road."""
    return levels.groupBy("road").agg((F.max("db") - F.min("db")).alias("spread_db"))


# What a mapped thing may be, by tag and value, the first that holds; words and states as published.
BARRIER_RULES = (
    ("wall", "noise_barrier", "explicit_noise_barrier_candidate"), ("barrier", "wall", "generic_wall_candidate"), ("barrier", "retaining_wall", "generic_wall_candidate"),
    ("barrier", "fence", "generic_fence_candidate"), ("barrier", "wire_fence", "generic_fence_candidate"), ("man_made", "embankment", "embankment_candidate"),
)
NO_BARRIER = "other_barrier_tag_no_acoustic_classification"
METRES, NO_HEIGHT, NOT_POSITIVE, NOT_METRES = "explicit_metres_unverified", "missing", "nonpositive_or_nonfinite", "ambiguous_or_unhandled_units"


def barrier_rules(spark: SparkSession) -> DataFrame:
    """The rules as a dimension: priority, tag, value, category."""
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(BARRIER_RULES)], "priority int, tag string, value string, category string")


def barriers(features: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """feature_id, category, height_m and height_state of features(feature_id, tags map); a wall on an embankment is a wall.

    None of them is taken for an acoustic screen. The rules are rows, joined by tag and value; the lowest priority counts.
    """
    rules = barrier_rules(features.sparkSession) if rules is None else rules
    tags = features.select("feature_id", F.explode("tags").alias("tag", "value"))
    best = tags.join(F.broadcast(rules), ["tag", "value"]).groupBy("feature_id").agg(F.min_by("category", "priority").alias("category"))  # six rules
    own = features.select("feature_id", tagged_height(F.try_element_at("tags", F.lit("height"))).alias("h")).join(best, "feature_id", "left")
    return own.select("feature_id", F.coalesce("category", F.lit(NO_BARRIER)).alias("category"), F.col("h.metres").alias("height_m"), F.col("h.state").alias("height_state"))


def tagged_height(text: Column) -> Column:
    """(metres, state) of a height as tagged: a bare decimal number, or one with m after it; all else is not read as metres."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = F.when(bare.rlike(r"^([0-9]+(\.[0-9]+)?|\.[0-9]+)\s*m?$"), F.regexp_extract(bare, r"^[0-9.]+", 0).try_cast("double"))
    known = (number > 0) & (number < float("inf"))
    state = F.when(F.coalesce(bare, F.lit("")) == "", NO_HEIGHT).when(number.isNull(), NOT_METRES).when(known, METRES).otherwise(NOT_POSITIVE)
    return F.struct(F.when(known, number).alias("metres"), state.alias("state"))


def path_ground(parts: DataFrame) -> DataFrame:
    """Ground factor of each path over its whole length; any class without a stated analogy withholds it.

    parts: path, code, length. Fixed analogies: grassland 30 and cropland 40 porous, built-up 50 and water 80 hard.
    """
    g = F.when(F.col("code").isin(30, 40), 1.0).when(F.col("code").isin(50, 80), 0.0)
    out = parts.withColumn("g", g).groupBy("path").agg(F.sum("length").alias("length"), F.sum(F.when(F.col("g").isNull(), F.col("length")).otherwise(0.0)).alias("unknown"), F.sum(F.coalesce("g", F.lit(0.0)) * F.col("length")).alias("gl"))
    return out.select("path", "length", "unknown", F.when(F.col("unknown") == 0, F.col("gl") / F.col("length")).alias("ground"))


def merged_runs(parts: DataFrame) -> DataFrame:
    """Neighbouring parts of a path with the same class made one. parts: path, seq, code, length."""
    order = W.partitionBy("path").orderBy("seq")
    turn = F.when(F.col("code").eqNullSafe(F.lag("code").over(order)), 0).otherwise(1)
    own = parts.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy("path", "run", "code").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("parts"))


def survey_winner(covers: DataFrame) -> DataFrame:
    """The survey of each pixel that has the resolution of all its rivals and began after each of them ended; else none.

    covers: pixel, survey, resolution, first_day, last_day. A survey that is not its pixel's newest loses, so the one that
    begins last is held against how many had not ended by then: itself alone.
    """
    last = covers.groupBy("pixel").agg(F.count(F.lit(1)).alias("surveys"), F.countDistinct("resolution").alias("resolutions"), F.max_by(F.struct("survey", "first_day"), F.struct("first_day", "survey")).alias("last"))
    running = covers.join(last.select("pixel", F.col("last.first_day").alias("begins")), "pixel").groupBy("pixel").agg(F.count_if(F.col("last_day") >= F.col("begins")).alias("running"))
    wins = (F.col("surveys") == 1) | ((F.col("resolutions") == 1) & (F.col("running") <= 1))
    return last.join(running, "pixel").select("pixel", "surveys", F.when(wins, F.col("last.survey")).alias("winner"))


def wind_sectors(hours: DataFrame, bearing: float, half: float = 60.0, least: float = 0.5) -> DataFrame:
    """Hours of each period with wind towards a bearing, and the bounds that the unknown hours leave. hours: period, speed, wind_from."""
    # the wind's heading, opposite to where it comes from, against the bearing: the cosine of the angle between the two
    along = -F.cos(F.radians(F.col("wind_from") - bearing)) - F.cos(F.radians(F.lit(half)))
    unknown = F.col("speed").isNull() | ((F.col("speed") >= least) & F.col("wind_from").isNull())
    out = hours.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("unknown"), F.count_if(~unknown & (F.col("speed") >= least) & (along >= -1e-9)).alias("downwind"), F.count_if(F.col("speed") < least).alias("calm"))
    return out.withColumns({"lower": F.col("downwind") / F.col("n"), "upper": (F.col("downwind") + F.col("unknown")) / F.col("n")})


def snapshots(start: DataFrame, end: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whether a mapped thing is the same in two snapshots."""
    a, b = (x.select(key, F.struct(*columns).alias(n)) for x, n in ((start, "a"), (end, "b")))
    state = F.when(F.col("a").isNull(), "not_in_start").when(F.col("b").isNull(), "not_in_end").when(F.col("a") == F.col("b"), "matching").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def terrain_obstruction(lines: DataFrame, terrain: DataFrame, cell: float = 100.0, parts: int = 9) -> DataFrame:
    """Largest rise of terrain above the straight line between two ends, at equal fractions. lines: line, x1..y2, z1, z2; terrain: cx, cy, z."""
    t = F.col("i") / F.lit(float(parts + 1))
    at = lines.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    at = at.withColumns({"cx": F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * t) / cell).cast("long"), "cy": F.floor((F.col("y1") + (F.col("y2") - F.col("y1")) * t) / cell).cast("long"), "ray": F.col("z1") + (F.col("z2") - F.col("z1")) * t})
    return at.join(terrain, ["cx", "cy"], "left").groupBy("line").agg(F.count("z").alias("seen"), F.max(F.col("z") - F.col("ray")).alias("excess"))


def one_recording(rows: DataFrame) -> DataFrame:
    """One row per group of a survey; groups whose rows disagree are set aside with the reason. rows: group_id, row_id, place, level."""
    out = rows.groupBy("group_id").agg(F.countDistinct("place", "level").alias("kinds"), F.sort_array(F.collect_list("row_id")).alias("row_ids"), F.first("place").alias("place"), F.first("level").alias("level"))
    ok = F.col("kinds") == 1
    return out.select("group_id", F.size("row_ids").cast("long").alias("rows"), F.element_at("row_ids", 1).alias("first_row"), F.when(ok, F.col("level")).alias("level"), F.when(ok, "kept").otherwise("conflicting_identity").alias("state"))
