"""Queries over intervals and survey counts derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac
from phonolith.operators import temporal as op
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx
from phonolith.sources.fixtures import COUNTS, INTERVALS

NEIGHBOURS = "i as (select *, end_s - start_s s, lag(end_s) over o prev, lag(level_db) over o prev_level from {t} x window o as (partition by receiver_id order by start_s, end_s))"


@query("ag25_interval_summary", INTERVALS, "with " + NEIGHBOURS + """
select receiver_id, sum(s)::bigint observed_s, count(*) filter (start_s > prev) gaps, max(level_db) max_db, coalesce(sum(s) filter (level_db < 40), 0)::bigint quiet_s,
  round(sum(s) / (max(end_s) - min(start_s)), 6) coverage, round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) laeq_db,
  case when count(*) filter (start_s > prev) = 0 then round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) end laeq_full_db from i group by 1""")
def _(x):
    return op.summary(x).withColumns({c: F.round(c, n) for c, n in (("coverage", 6), ("laeq_db", 4), ("laeq_full_db", 4))})


#: Windows of full hours about what was heard; some begin too late, some end with the last interval, some receivers have none.
WINDOWS = """
select receiver_id, cast(floor(min(start_s) / 3600.0) * 3600 as bigint) + case when mod(receiver_id, 5) = 1 then 7200 else 0 end window_start_s,
  case when mod(receiver_id, 4) = 0 then max(end_s) else cast(ceil(max(end_s) / 3600.0) * 3600 as bigint) + 3600 end window_end_s from ({t}) q where mod(receiver_id, 11) <> 3 group by receiver_id
"""


@query("ag25_observation_windows", sql=f"""
with w as ({WINDOWS.replace("{t}", fx.plain(INTERVALS))}),
r as (select distinct receiver_id from ({fx.plain(INTERVALS)}) q),
i as (select r.receiver_id, x.start_s, x.end_s, x.level_db, x.end_s - x.start_s s, window_start_s a, window_end_s b, lag(x.end_s) over (partition by r.receiver_id order by x.start_s, x.end_s) before
  from r join ({fx.plain(INTERVALS)}) x on x.receiver_id = r.receiver_id left join w on w.receiver_id = r.receiver_id),
g as (select receiver_id, case when max(a) is null then 'no_window' when max(b) <= max(a) then 'empty_window' when count(*) filter (start_s < a or end_s > b) > 0 then 'outside_window'
    when count(*) filter (before > start_s) > 0 then 'overlap' else 'summarised' end status,
  sum(s)::bigint observed, max(b - a) whole, max(level_db) top, coalesce(sum(s) filter (level_db < 40), 0)::bigint quiet, sum(s * pow(10, level_db / 10)) energy from i group by 1)
select receiver_id, status, case when status = 'summarised' then observed end observed_s, case when status = 'summarised' then whole - observed end missing_s,
  case when status = 'summarised' then round(observed / whole, 6) end coverage, case when status = 'summarised' then observed = whole end complete, case when status = 'summarised' then top end max_db,
  case when status = 'summarised' then quiet end quiet_s, case when status = 'summarised' then round(10 * log10(energy / observed), 4) end laeq_db,
  case when status = 'summarised' and observed = whole then round(10 * log10(energy / observed), 4) end laeq_full_db from g""")
def _(spark, d):
    heard = fx.derived(spark, d, INTERVALS)
    windows = spark.sql(WINDOWS.replace("({t}) q", "{t}"), t=heard)
    return op.window_summary(heard, windows).withColumns({c: F.round(c, n) for c, n in (("coverage", 6), ("laeq_db", 4), ("laeq_full_db", 4))})


@query("ag26_wn7_exceedance", INTERVALS, """
with l as (select receiver_id, level_db, sum(end_s - start_s) s from {t} x group by 1, 2),
r as (select *, sum(s) over (partition by receiver_id order by level_db) upto, sum(s) over (partition by receiver_id) whole from l)
select receiver_id, min(level_db) filter (upto >= whole * 0.1) la90_db, min(level_db) filter (upto >= whole * 0.5) la50_db from r group by 1""")
def _(x):
    return op.exceedance(x, {"la90_db": 0.1, "la50_db": 0.5})


@query("wn4_quiet_runs", INTERVALS, "with " + NEIGHBOURS + """,
b as (select *, sum(case when level_db < 40 and prev_level < 40 and prev = start_s then 0 else 1 end) over (partition by receiver_id order by start_s, end_s rows unbounded preceding) run from i),
l as (select receiver_id, run, sum(s) s from b where level_db < 40 group by 1, 2)
select receiver_id, max(s)::bigint longest_quiet_s, count(*) runs from l group by 1""")
def _(x):
    return op.quiet_runs(x)


@query("wn6_interval_joins", INTERVALS, "with " + NEIGHBOURS + """
select receiver_id, count(*) filter (start_s > prev) gaps, count(*) filter (start_s < prev) "overlaps", count(*) filter (start_s = prev) joins from i group by 1""")
def _(x):
    return op.overlaps(x)


@query("sm1_hourly_levels", INTERVALS, """
with h as (select *, unnest(range(start_s // 3600, (end_s - 1) // 3600 + 1)) hr from {t} x),
c as (select *, least(end_s, (hr + 1) * 3600) - greatest(start_s, hr * 3600) s from h)
select receiver_id, hr::bigint "hour", sum(s)::bigint observed_s, round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) laeq_db from c group by 1, 2""")
def _(x):
    return op.hourly(x).withColumn("laeq_db", F.round("laeq_db", 4))


@query("ag19_survey_days", COUNTS, """
select count_point_id, count_date, count(distinct direction) directions, count(distinct hr) "hours", sum(flow)::bigint flow, case when count(*) filter (hr % 11 = 5 and count_point_id % 3 = 0) = 0 then sum(hgv) end::bigint hgv,
  count(distinct direction || hr) filter (hr between 7 and 18) = 12 * count(distinct direction) complete_07_19 from {t} x group by 1, 2""")
def _(x):
    return op.survey_days(x.withColumn("hgv", F.when(~((F.col("hr") % 11 == 5) & (F.col("count_point_id") % 3 == 0)), F.col("hgv"))))


@query("ag20_directional_share", COUNTS, """
with b as (select count_point_id, direction, sum(flow) f from {t} x group by 1, 2), p as (select count_point_id, count(*) directions, sum(f)::bigint flow, max(f) / sum(f) s from b group by 1)
select count_point_id, directions, flow, round(s, 6) larger_share, case when count_point_id % 7 <> 6 then count_point_id % 4 end residual, case when count_point_id % 7 = 6 then 'no_total' when count_point_id % 4 > 1 then 'residual_too_large' when directions = 1 then 'single_direction' when s > 0.6 then 'unbalanced' else 'balanced' end status from p""")
def _(x):
    totals = x.where("count_point_id % 7 <> 6").groupBy("count_point_id").agg((F.sum("flow") + F.first("count_point_id") % 4).alias("total"))
    return op.directional(x, totals).withColumn("larger_share", F.round("larger_share", 6))


@query("ag41_wn10_hour_profile", COUNTS, """
with b as (select dayofweek(count_date) + 1 weekday, hr, sum(flow)::bigint flow from {t} x group by 1, 2), s as (select *, flow / sum(flow) over (partition by weekday) share from b)
select weekday, hr, flow, round(share, 6) share, round(sum(abs(share - 1.0::double / 24)) over (partition by weekday) / 2, 6) variation from s""")
def _(x):
    return op.hour_profile(x).withColumns({c: F.round(c, 6) for c in ("share", "variation")})


@query("jn18_calendar_weights", COUNTS, """
with b as (select dayofweek(count_date) + 1 weekday, hr, sum(flow)::bigint flow from {t} x group by 1, 2), s as (select *, flow / sum(flow) over (partition by weekday) share from b),
d as (select dayofweek(d) + 1 weekday, h.range hr, count(*) times from range(date '2021-01-01', date '2022-01-01', interval 1 day) r(d), range(0, 24) h group by 1, 2),
j as (select d.weekday, d.hr, times, coalesce(share, 0) share from d left join s on s.weekday = d.weekday and s.hr = d.hr)
select weekday, hr, times, round(share / (select sum(times * share) from j), 8) weight from j""")
def _(x):
    profile = op.hour_profile(x).select("weekday", "hr", "share")
    return op.calendar_weights(x.sparkSession, profile, 2021).withColumn("weight", F.round("weight", 8))


#: Indices by weekday and civil hour from the counts; an hour never counted has an index of 1.
CURVES = """b as (select dayofweek(count_date) + {one} weekday, hr, sum(flow) flow, sum(hgv) hgv from {t} x group by 1, 2),
g as (select d.n weekday, h.n hr from {days} d cross join {hours} h),
c as (select g.weekday, g.hr, 1.0 + coalesce(flow, 0) flow, 1.0 + coalesce(hgv, 0) hgv from g left join b on b.weekday = g.weekday and b.hr = g.hr),
p as (select 'all' vehicle_group, weekday, hr, cast(flow as double) idx from c union all select 'heavy', weekday, hr, cast(hgv as double) from c)"""
ONE_YEAR = CURVES.replace("{one}", "1").replace("{days}", "(select range n from range(1, 8))").replace("{hours}", "(select range n from range(0, 24))") + """,
u as (select range slot, timestamp '2021-01-01' + range * interval 1 hour utc from range(0, 8760)),
l as (select *, utc + case when utc >= timestamp '2021-03-28 01:00' and utc < timestamp '2021-10-31 01:00' then interval 1 hour else interval 0 hour end local, utc = timestamp '2021-10-31 01:00' repeated from u),
y as (select slot, dayofweek(local) + 1 weekday, hour(local) hr, repeated, case when hour(local) between 7 and 18 then 'day' when hour(local) between 19 and 22 then 'evening' else 'night' end period from l),
w as (select y.*, vehicle_group, idx * case when period = 'night' then 1.5::double else 1.0::double end raw from y join p on p.weekday = y.weekday and p.hr = y.hr),
z as (select *, raw / sum(raw) over (partition by vehicle_group) weight from w)"""


def yearly(counts):
    spark = counts.sparkSession
    curves = CURVES.replace("{one}", "0").replace("{days}", "(select explode(sequence(1, 7)) n)").replace("{hours}", "(select explode(sequence(0, 23)) n)").replace("{t} x", "{t}")
    indices = spark.sql("with " + curves + " select vehicle_group, weekday, hr, idx as index from p", t=counts)
    return op.hourly_weights(spark, indices, 2021, 1.5)


@query("jn18_civil_year", COUNTS, "with " + ONE_YEAR + """
select slot, weekday, hr, repeated, period, vehicle_group, round(weight, 10) weight from z""")
def _(x):
    return yearly(x).select("slot", "weekday", "hr", "repeated", "period", "vehicle_group", F.round("weight", 10).alias("weight"))


@query("jn18_period_fractions", COUNTS, "with " + ONE_YEAR + """
select vehicle_group, period, count(*) "hours", round(sum(weight), 8) fraction from z group by 1, 2""")
def _(x):
    return yearly(x).groupBy("vehicle_group", "period").agg(F.count(F.lit(1)).alias("hours"), F.round(F.sum("weight"), 8).alias("fraction"))


@query("ag21_period_flows", COUNTS, """
with p as (select count_point_id, coalesce(sum(flow) filter (hr between 7 and 18), 0)::bigint "day", coalesce(sum(flow) filter (hr between 19 and 22), 0)::bigint evening, coalesce(sum(flow) filter (hr < 7 or hr = 23), 0)::bigint night from {t} x group by 1)
select *, round(("day" + sqrt(10) * evening + 10 * night) / 24, 4) den_flow from p""")
def _(x):
    return op.period_levels(x).withColumn("den_flow", F.round("den_flow", 4))


@query("jn17_hourly_reports", sql="""
with r as (select event_id report_id, ts, event_type <> 'error' good, user_id % 3 = 0 synoptic, date_trunc('hour', ts + interval 30 minutes) slot from events),
b as (select *, row_number() over (partition by slot order by good desc, abs(epoch_us(ts) - epoch_us(slot)), synoptic desc, report_id) n, count(*) over (partition by slot) reports from r),
h as (select s slot from range((select date_trunc('day', min(ts)) from events), (select max(ts) + interval 30 minutes from events), interval 1 hour) t(s))
select h.slot, b.report_id, b.good, b.reports from h left join b on b.slot = h.slot and b.n = 1""")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    start, hours = events.agg(F.date_trunc("day", F.min("ts")).alias("a"), F.max("ts").alias("b")).select(F.col("a").cast("string"), F.ceil((F.unix_micros("b") + 1_800_000_000 - F.unix_micros("a")) / 3_600_000_000)).first()
    reports = events.select(F.col("event_id").alias("report_id"), "ts", (F.col("event_type") != "error").alias("good"), (F.col("user_id") % 3 == 0).alias("synoptic"))
    return op.hourly_reports(reports, start, hours)


@query("prj19_prj28_air", sql="""
with a as (select p_partkey, p_size - 10.0::double t, p_size - 10.0::double - p_partkey % 20 td, 95.0::double + p_partkey % 10 p from part),
h as (select *, case when t between -20 and 50 and td >= -80 then 100 * exp(17.67 * td / (td + 243.5) - 17.67 * t / (t + 243.5)) end rh from a),
f as (select *, (t + 273.15) / 293.15 r, p / 101.325 q, coalesce(rh, 70.0) h0 from h),
g as (select *, h0 * 101.325 * pow(10, -6.8346 * pow(273.16 / (t + 273.15), 1.261) + 4.6151) / p h1 from f),
x as (select *, q * (24 + 40400 * h1 * (0.02 + h1) / (0.391 + h1)) o, q * pow(r, -0.5) * (9 + 280 * h1 * exp(-4.17 * (pow(r, -1.0::double / 3) - 1))) n from g)
select p_partkey, round(rh, 4) rh, case when rh is null then 'explicit_gap_reference' else 'derived_station_transfer' end basis,
  case when h0 between 10 and 100 then round(1000 * 8.686 * 1e6 * (1.84e-11 / q * sqrt(r) + pow(r, -2.5) * (0.01275 * exp(-2239.1 / (t + 273.15)) / (o + 1e6 / o) + 0.1068 * exp(-3352 / (t + 273.15)) / (n + 1e6 / n))), 4) end alpha from x""")
def _(spark, d):
    a = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") - F.lit(10.0)).alias("t"), (F.lit(95.0) + F.col("p_partkey") % 10).alias("p"))
    a = a.withColumn("rh", ac.relative_humidity(F.col("t"), F.col("t") - F.col("p_partkey") % 20))
    alpha = ac.absorption_db_per_km(F.lit(1000.0), F.col("t"), F.coalesce("rh", F.lit(70.0)), F.col("p"))
    basis = F.when(F.col("rh").isNull(), "explicit_gap_reference").otherwise("derived_station_transfer")
    return a.select("p_partkey", F.round("rh", 4).alias("rh"), basis.alias("basis"), F.round(alpha, 4).alias("alpha"))
