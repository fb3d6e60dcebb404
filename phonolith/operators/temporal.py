"""Operators over sound intervals (receiver_id, start_s, end_s, level_db) and survey counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac

RX = "receiver_id"


def summary(intervals: DataFrame, quiet_db: float = 40.0) -> DataFrame:
    """Per receiver: observed seconds, LAeq of observed time, coverage, and LAeq of the whole window only if gap-free."""
    order = W.partitionBy(RX).orderBy("start_s", "end_s")
    own = intervals.withColumns({"gap": F.col("start_s") - F.lag("end_s").over(order), "s": F.col("end_s") - F.col("start_s")})
    out = own.groupBy(RX).agg(
        F.sum("s").alias("observed_s"), F.min("start_s").alias("from_s"), F.max("end_s").alias("to_s"), F.sum(F.col("s") * ac.db_to_energy(F.col("level_db"))).alias("energy"),
        F.count_if(F.col("gap") > 0).alias("gaps"), F.max("level_db").alias("max_db"), F.sum(F.when(F.col("level_db") < quiet_db, F.col("s")).otherwise(0)).alias("quiet_s"),
    )
    laeq = ac.energy_to_db(F.col("energy") / F.col("observed_s"))
    return out.select(RX, "observed_s", "gaps", "max_db", "quiet_s", (F.col("observed_s") / (F.col("to_s") - F.col("from_s"))).alias("coverage"), laeq.alias("laeq_db"), F.when(F.col("gaps") == 0, laeq).alias("laeq_full_db"))


def window_summary(intervals: DataFrame, windows: DataFrame, quiet_db: float = 40.0) -> DataFrame:
    """Each receiver's intervals against the window it was to be observed in; one row a window, also for one without intervals.

    windows: receiver_id, window_start_s, window_end_s, one a receiver. Levels are interval energy means. `status` names the
    first fault: no_window, empty_window, invalid_interval (missing or endless values, an end not after its start),
    outside_window, overlap; summaries of a faulty receiver are null, as nothing may be repaired. laeq_full_db needs every
    second of the window covered, its ends included.
    """
    order = W.partitionBy(RX).orderBy("start_s", "end_s")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    own = intervals.select(RX, "start_s", "end_s", "level_db", F.lag("end_s").over(order).alias("before"), F.lit(True).alias("heard")).join(windows.withColumn("known", F.lit(True)), RX, "full")
    heard = F.coalesce("heard", F.lit(False))
    valid = finite("start_s") & finite("end_s") & finite("level_db") & (F.col("end_s") > F.col("start_s"))
    reach, s = F.col("window_end_s") - F.col("window_start_s"), F.col("end_s") - F.col("start_s")
    kinds = F.when(F.col("known").isNull(), 1).when(~(finite("window_start_s") & finite("window_end_s")) | (reach <= 0), 2).when(heard & ~valid, 3)
    kinds = kinds.when(heard & ((F.col("start_s") < F.col("window_start_s")) | (F.col("end_s") > F.col("window_end_s"))), 4).when(heard & (F.col("before") > F.col("start_s")), 5).otherwise(6)
    out = own.withColumns({"kind": kinds, "s": F.when(heard, s)}).groupBy(RX).agg(
        F.min("kind").alias("kind"), F.coalesce(F.sum("s"), F.lit(0)).alias("observed_s"), F.max(reach).alias("window_s"), F.max("level_db").alias("max_db"),
        F.sum(F.col("s") * ac.db_to_energy(F.col("level_db"))).alias("energy"), F.coalesce(F.sum(F.when(F.col("level_db") < quiet_db, F.col("s"))), F.lit(0)).alias("quiet_s"),
    )
    names = F.element_at(F.array(*(F.lit(x) for x in ("no_window", "empty_window", "invalid_interval", "outside_window", "overlap", "summarised"))), F.col("kind"))
    ok = F.col("kind") == 6
    laeq = F.when(ok & (F.col("observed_s") > 0), ac.energy_to_db(F.col("energy") / F.col("observed_s")))
    full = F.col("observed_s") == F.col("window_s")  # without overlaps, within the window: nothing is missing
    said = {"observed_s": F.col("observed_s"), "missing_s": F.col("window_s") - F.col("observed_s"), "coverage": F.col("observed_s") / F.col("window_s"), "complete": full, "max_db": F.col("max_db"), "quiet_s": F.col("quiet_s")}
    return out.select(RX, names.alias("status"), *(F.when(ok, c).alias(n) for n, c in said.items()), laeq.alias("laeq_db"), F.when(full, laeq).alias("laeq_full_db"))


def exceedance(intervals: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Duration-weighted levels by the inverse distribution: the first level, from low to high, whose time reaches a share."""
    level = intervals.groupBy(RX, "level_db").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("s"))
    order = W.partitionBy(RX).orderBy("level_db")
    run = level.withColumns({"upto": F.sum("s").over(order.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("s").over(W.partitionBy(RX))})
    return run.groupBy(RX).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("level_db"))).alias(name) for name, share in shares.items()])


def quiet_runs(intervals: DataFrame, quiet_db: float = 40.0) -> DataFrame:
    """Longest run of time below quiet_db of each receiver; a gap or a louder interval ends a run."""
    order = W.partitionBy(RX).orderBy("start_s", "end_s")
    own = intervals.withColumn("quiet", F.col("level_db") < quiet_db)
    breaks = F.when(F.col("quiet") & F.lag("quiet").over(order) & (F.lag("end_s").over(order) == F.col("start_s")), 0).otherwise(1)
    runs = own.withColumn("b", breaks).withColumn("run", F.sum("b").over(order.rowsBetween(W.unboundedPreceding, 0)))
    length = runs.where("quiet").groupBy(RX, "run").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("s"))
    return length.groupBy(RX).agg(F.max("s").alias("longest_quiet_s"), F.count(F.lit(1)).alias("runs"))


def overlaps(intervals: DataFrame) -> DataFrame:
    """Counts of gaps, overlaps and seamless joins between neighbouring intervals of a receiver."""
    order = W.partitionBy(RX).orderBy("start_s", "end_s")
    gap = F.col("start_s") - F.lag("end_s").over(order)
    return intervals.withColumn("gap", gap).groupBy(RX).agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"), F.count_if(F.col("gap") == 0).alias("joins"))


def hourly(intervals: DataFrame) -> DataFrame:
    """LAeq of each receiver and clock hour; an interval is split at hour edges, and time not observed stays missing."""
    hours = F.sequence(F.floor(F.col("start_s") / 3600).cast("long"), F.floor((F.col("end_s") - 1) / 3600).cast("long"))
    cut = intervals.withColumn("hour", F.explode(hours))
    s = F.least("end_s", (F.col("hour") + 1) * 3600) - F.greatest("start_s", F.col("hour") * 3600)
    out = cut.withColumn("s", s).groupBy(RX, "hour").agg(F.sum("s").alias("observed_s"), F.sum(F.col("s") * ac.db_to_energy(F.col("level_db"))).alias("energy"))
    return out.select(RX, "hour", "observed_s", ac.energy_to_db(F.col("energy") / F.col("observed_s")).alias("laeq_db"))


def sum_if_known(column: Column) -> Column:
    """The sum, or null if any value is missing: a part is not given out as the whole."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def survey_days(counts: DataFrame) -> DataFrame:
    """Each count point's survey day: directions, hours, whether 07-19 is complete in both directions, totals."""
    day = F.col("hr").between(7, 18)
    out = counts.groupBy("count_point_id", "count_date").agg(
        F.countDistinct("direction").alias("directions"), F.countDistinct("hr").alias("hours"),
        F.countDistinct(F.when(day, F.struct("direction", "hr"))).alias("day_cells"), sum_if_known(F.col("flow")).alias("flow"), sum_if_known(F.col("hgv")).alias("hgv"),
    )
    return out.withColumn("complete_07_19", F.col("day_cells") == 12 * F.col("directions")).drop("day_cells")


def directional(counts: DataFrame, totals: DataFrame, allowed: float = 1.0) -> DataFrame:
    """Directions of each count point against its published total: share of the larger one, what the sum lacks, and a status.

    totals: count_point_id, total. A residual of rounding is allowed.
    """
    by = counts.groupBy("count_point_id", "direction").agg(F.sum("flow").alias("flow"))
    out = by.groupBy("count_point_id").agg(F.count(F.lit(1)).alias("directions"), F.sum("flow").alias("flow"), F.max("flow").alias("larger"))
    out = out.join(totals, "count_point_id", "left").withColumn("residual", F.col("total") - F.col("flow"))
    share = F.col("larger") / F.col("flow")
    status = F.when(F.col("residual").isNull(), "no_total").when(F.abs("residual") > allowed, "residual_too_large").when(F.col("directions") == 1, "single_direction").when(share > 0.6, "unbalanced").otherwise("balanced")
    return out.select("count_point_id", "directions", "flow", share.alias("larger_share"), "residual", status.alias("status"))


def hour_profile(counts: DataFrame) -> DataFrame:
    """Share of each weekday's flow by hour, and the distance (half the summed differences) from a flat profile."""
    by = counts.groupBy(F.dayofweek("count_date").cast("long").alias("weekday"), "hr").agg(F.sum("flow").alias("flow"))
    out = by.withColumn("share", F.col("flow") / F.sum("flow").over(W.partitionBy("weekday")))
    return out.withColumn("variation", F.sum(F.abs(F.col("share") - 1 / 24)).over(W.partitionBy("weekday")) / 2)


def hourly_reports(reports: DataFrame, start: str, hours: int) -> DataFrame:
    """One report for each clock hour: of those nearest to it (half hours go forward) good ones first, then the closest, then synoptic ones, then the lowest number.

    reports: report_id, ts, good (strict quality), synoptic (report type). Hours without a report stay, with nulls.
    """
    slot = F.date_trunc("hour", F.col("ts") + F.expr("interval 30 minutes"))
    own = reports.withColumn("slot", slot)
    off = F.abs(F.unix_micros("ts") - F.unix_micros("slot"))
    order = W.partitionBy("slot").orderBy(F.desc("good"), off, F.desc("synoptic"), "report_id")
    best = own.withColumns({"n": F.row_number().over(order), "reports": F.count(F.lit(1)).over(W.partitionBy("slot"))}).where("n = 1")
    spine = reports.sparkSession.range(hours).select((F.lit(start).cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("slot"))
    return spine.join(best.select("slot", "report_id", "good", "reports"), "slot", "left")


def calendar_weights(spark, profile: DataFrame, year: int) -> DataFrame:
    """Each hour's part of the year's flow for a weekday-and-hour profile: hours of the year joined to their index, normalised."""
    days = spark.sql(f"select explode(sequence(date'{year}-01-01', date'{year}-12-31')) day")
    spine = days.withColumn("hr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))).withColumn("weekday", F.dayofweek("day").cast("long"))
    per = spine.groupBy("weekday", "hr").agg(F.count(F.lit(1)).alias("times")).join(profile, ["weekday", "hr"], "left")
    total = per.agg(F.sum(F.col("times") * F.coalesce("share", F.lit(0.0))).alias("total"))
    return per.crossJoin(F.broadcast(total)).select("weekday", "hr", "times", (F.coalesce("share", F.lit(0.0)) / F.col("total")).alias("weight"))


def civil_hours(spark: SparkSession, year: int, zone: str = "Europe/London") -> DataFrame:
    """Every elapsed hour of a year: slot (hours since its start in UTC), utc, local, weekday (1: Sunday), hr, repeated, period.

    The clock is the zone's: in autumn an hour comes twice (the second time it is `repeated`), in spring one is missing.
    Times are without zone, so the session's own plays no part.
    """
    begin = f"timestamp_ntz'{year}-01-01 00:00:00'"
    hours = spark.sql(f"select explode(sequence({begin}, timestamp_ntz'{year}-12-31 23:00:00', interval 1 hour)) utc")
    local = lambda at: f"convert_timezone('UTC', '{zone}', {at})"
    ahead = lambda at: f"timestampdiff(minute, {at}, {local(at)})"
    own = hours.select(F.expr(f"timestampdiff(hour, {begin}, utc)").alias("slot"), "utc", F.expr(local("utc")).alias("local"), F.expr(f"{ahead('utc')} < {ahead('(utc - interval 1 hour)')}").alias("repeated"))
    return own.select("slot", "utc", "local", F.dayofweek("local").cast("long").alias("weekday"), F.hour("local").cast("long").alias("hr"), "repeated").withColumn("period", period_of(F.col("hr")))


def hourly_weights(spark: SparkSession, indices: DataFrame, year: int, night: float = 1.0, zone: str = "Europe/London") -> DataFrame:
    """Each elapsed hour's part of a year's flow, for every vehicle group of indices(vehicle_group, weekday, hr, index).

    An index applies to every hour of its weekday and civil hour, those of the night times `night`; the whole year is
    normalised, so weights of a group add up to 1. A group needs one finite index for each of 168 hours and a positive sum.
    """
    if not 0 < night < float("inf"):
        raise ValueError("the night's factor must be positive")
    index = F.col("index").cast("double")
    good = index.isNotNull() & ~F.isnan(index) & (F.abs(index) < float("inf")) & F.col("weekday").between(1, 7) & F.col("hr").between(0, 23)
    kinds = indices.groupBy("vehicle_group").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(good, F.struct("weekday", "hr"))).alias("hours"), F.sum(index).alias("sum"))
    bad = kinds.where("good <> 168 or rows <> 168 or hours <> 168 or not sum > 0").limit(5).collect()
    if bad:
        raise ValueError(f"incomplete profiles: {sorted(str(r.vehicle_group) for r in bad)}")
    # the year against the profile is a fixed 8,784 rows at most; only the number of groups grows
    own = F.broadcast(civil_hours(spark, year, zone)).join(indices.select("vehicle_group", "weekday", "hr", index.alias("index")), ["weekday", "hr"])
    raw = own.withColumn("raw", F.col("index") * F.when(F.col("period") == "night", night).otherwise(1.0))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(W.partitionBy("vehicle_group"))).drop("raw", "index")


def period_of(hour: Column) -> Column:
    """Day 07-19, evening 19-23, night otherwise."""
    return F.when(hour.between(7, 18), "day").when(hour.between(19, 22), "evening").otherwise("night")


def period_levels(counts: DataFrame) -> DataFrame:
    """Period flows of each count point, with the day-evening-night mean that weighs evenings by 10^0.5 and nights by 10."""
    own = counts.withColumn("period", period_of(F.col("hr")))
    flow = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("flow"))), F.lit(0))
    out = own.groupBy("count_point_id").agg(flow("day").alias("day"), flow("evening").alias("evening"), flow("night").alias("night"))
    den = (F.col("day") + F.lit(10.0**0.5) * F.col("evening") + 10.0 * F.col("night")) / 24
    return out.withColumn("den_flow", den)
