"""Queries about emission and the scene, over tables derived from suppliers, customers, parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.operators import scenes as op
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

FLOWS = """
select s_suppkey road, period, category, cast(10 + mod(s_suppkey * 31, 500) + 7 * k as double) per_hour, cast(30 + mod(s_suppkey * 17 + k, 90) as double) speed_kmh
from {supplier} s cross join (select 'day' period union all select 'evening' union all select 'night') p
cross join (select '1' category, 0 k union all select '2', 1 union all select '3', 2 union all select '4b', 3) c
"""
VALUES = ", ".join(f"('{c}', {b}, {ar[i] if ar else 'null'}, {br[i] if br else 'null'}, {ap[i]}, {bp[i]})" for c, (ar, br, ap, bp) in op.COEFFICIENTS.items() for i, b in enumerate(op.BANDS))
SPECTRA = f"""k(category, band, ar, br, ap, bp) as (values {VALUES}),
p as (select f.*, band, pow(10, (ap + bp * (speed_kmh - 70) / 70) / 10) + coalesce(pow(10, (ar + br * log10(speed_kmh / 70)) / 10), 0) power from {{t}} f join k using (category)),
s as (select road, period, band, sum(power * per_hour / (1000 * speed_kmh)) power from p group by 1, 2, 3)"""


@query("prj18_ag21_source_spectra", FLOWS, "with " + SPECTRA + " select road, period, band, round(10 * log10(power), 4) power_db from s")
def _(flows):
    return op.spectra(flows).select("road", "period", "band", F.round(10 * F.log10("power"), 4).alias("power_db"))


DEN = SPECTRA + f""", a(band, w) as (values {", ".join(f"({b}, {w})" for b, w in zip(op.BANDS, op.A_WEIGHT, strict=True))}),
d as (select road, 10 * log10(sum(power * case period when 'day' then 12.0 when 'evening' then 4 * sqrt(10) else 80.0 end / 24 * pow(10, w / 10))) db from s join a using (band) group by 1)"""


@query("ag22_den_levels", FLOWS, "with " + DEN + " select road, round(db, 4) den_db from d")
def _(flows):
    return op.den_levels(op.spectra(flows)).withColumn("den_db", F.round("den_db", 4))


def cases(flows):
    levels = op.den_levels(op.spectra(flows)).withColumnRenamed("den_db", "db")
    of = lambda case, db: F.struct(F.lit(case).alias("case_id"), db.alias("db"))
    made = F.array(of("anchor", F.col("db")), of("double", F.col("db") + 3), of("mixed", F.col("db") + F.pmod("road", F.lit(7)) - 3))
    return levels.select("road", F.explode(made).alias("c")).select("road", "c.*")


CASES = DEN + ", c as (select road, 'anchor' case_id, db from d union all select road, 'double', db + 3 from d union all select road, 'mixed', db + road % 7 - 3 from d)"


@query("ag45_case_differences", FLOWS, "with " + CASES + """, j as (select c.case_id, c.db - a.db d from c join c a on a.road = c.road and a.case_id = 'anchor')
select case_id, count(*) roads, round(min(d), 4) min_d, round(quantile_cont(d, 0.1), 4) p10, round(quantile_cont(d, 0.5), 4) p50, round(quantile_cont(d, 0.9), 4) p90, round(max(d), 4) max_d from j group by 1""")
def _(flows):
    return op.case_differences(cases(flows)).withColumns({c: F.round(c, 4) for c in ("min_d", "p10", "p50", "p90", "max_d")})


@query("ag46_case_spread", FLOWS, "with " + CASES + " select road, round(max(db) - min(db), 4) spread_db from c group by 1")
def _(flows):
    return op.case_spread(cases(flows)).withColumn("spread_db", F.round("spread_db", 4))


PARTS = """
select cast(mod(p_partkey, 200) as bigint) path, p_partkey seq, cast(10 * (1 + mod(cast(floor(p_partkey / 3.0) as bigint), 8)) as bigint) code, cast(p_size as double) length, p_name name, p_type kind from {part}
"""


@query("ag37_path_ground", PARTS, """
select path, sum(length) length, sum(case when code in (30, 40, 50, 80) then 0.0::double else length end) "unknown", case when count(*) filter (code not in (30, 40, 50, 80)) = 0 then sum(case when code in (30, 40) then length else 0 end) / sum(length) end ground from {t} x group by 1""")
def _(parts):
    return op.path_ground(parts.select("path", "code", "length"))


@query("wn15_merged_runs", PARTS, """
with l as (select *, case when code is not distinct from lag(code) over (partition by path order by seq) then 0 else 1 end turn from {t} x), r as (select *, sum(turn) over (partition by path order by seq rows unbounded preceding)::bigint run from l)
select path, run, code, sum(length) length, count(*) parts from r group by 1, 2, 3""")
def _(parts):
    return op.merged_runs(parts)


HEIGHTS = ("2", " 2.5 m ", ".5m", "0", "3 metres", "5.", "6 ft", "2-3", "", None, "0.0", "+2", "1e1", "12m", "7,5")


@query("prj21_barrier_tags", PARTS, """
with h as (select * from (values (0, 2.0, 'explicit_metres_unverified'), (1, 2.5, 'explicit_metres_unverified'), (2, 0.5, 'explicit_metres_unverified'), (3, null, 'nonpositive_or_nonfinite'), (4, null, 'ambiguous_or_unhandled_units'),
  (5, null, 'ambiguous_or_unhandled_units'), (6, null, 'ambiguous_or_unhandled_units'), (7, null, 'ambiguous_or_unhandled_units'), (8, null, 'missing'), (9, null, 'missing'), (10, null, 'nonpositive_or_nonfinite'), (11, null, 'ambiguous_or_unhandled_units'),
  (12, null, 'ambiguous_or_unhandled_units'), (13, 12.0, 'explicit_metres_unverified'), (14, null, 'ambiguous_or_unhandled_units')) v(k, m, s))
select x.seq feature_id, case when name like 'red%' then 'explicit_noise_barrier_candidate' when kind = 'ECONOMY' or kind = 'PROMO' and seq % 2 = 0 then 'generic_wall_candidate' when kind = 'SMALL' then 'generic_fence_candidate' when kind = 'PROMO' or kind = 'LARGE' and seq % 3 = 0 then 'embankment_candidate'
  else 'other_barrier_tag_no_acoustic_classification' end category, m::double height_m, s height_state from {t} x join h on h.k = x.seq % 15""")
def _(parts):
    """Walls on embankments, dykes, hedges; heights as people write them."""
    kind, even = F.col("kind"), F.col("seq") % 2 == 0
    barrier = F.when(kind == "ECONOMY", "wall").when((kind == "PROMO") & even, "retaining_wall").when(kind == "SMALL", "wire_fence").when(kind == "STANDARD", "hedge")
    made = F.when(kind == "PROMO", "embankment").when(kind == "LARGE", F.when(F.col("seq") % 3 == 0, "embankment").otherwise("dyke"))
    height = F.get(F.array(*(F.lit(h) for h in HEIGHTS)), (F.col("seq") % len(HEIGHTS)).cast("int"))
    tags = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("barrier", barrier), ("man_made", made), ("wall", F.when(F.col("name").startswith("red"), "noise_barrier")), ("height", height)))), lambda e: e["value"].isNotNull()))
    return op.barriers(parts.select(F.col("seq").alias("feature_id"), tags.alias("tags")))


SURVEYS = """
select cast(mod(o_orderkey, 3000) as bigint) pixel, o_orderkey survey, cast(1 + mod(o_custkey, 2) as bigint) resolution, cast(mod(o_custkey * 7, 900) as bigint) first_day, cast(mod(o_custkey * 7, 900) + mod(o_orderkey, 30) as bigint) last_day from {orders}
"""


@query("ag36_survey_winner", SURVEYS, """
select pixel, count(*) surveys, (select a.survey from {t} a where a.pixel = x.pixel and not exists (select 1 from {t} b where b.pixel = a.pixel and b.survey <> a.survey and not (b.resolution = a.resolution and a.first_day > b.last_day))) winner from {t} x group by 1""")
def _(covers):
    return op.survey_winner(covers)


@query("ag24_wind_sectors", sql="""
with h as (select case when hour(ts) between 7 and 18 then 'day' when hour(ts) between 19 and 22 then 'evening' else 'night' end period, case when event_id % 11 = 0 then null else "value" / 10 end speed, case when event_id % 7 = 0 then null else event_id * 37 % 360 end f from events),
k as (select *, speed is null or (speed >= 0.5 and f is null) u from h)
select period, count(*) n, count(*) filter (u) "unknown", count(*) filter (speed < 0.5) calm, count(*) filter (not u and speed >= 0.5 and abs((f + 180 - 90 + 180) % 360 - 180) <= 60) downwind, round(count(*) filter (not u and speed >= 0.5 and abs((f + 180 - 90 + 180) % 360 - 180) <= 60) / count(*), 6) "lower",
  round((count(*) filter (u) + count(*) filter (not u and speed >= 0.5 and abs((f + 180 - 90 + 180) % 360 - 180) <= 60)) / count(*), 6) "upper" from k group by 1""")
def _(spark, d):
    from phonolith.operators.temporal import period_of

    e = spark.read.parquet(f"{d}/events.parquet")
    hours = e.select(period_of(F.hour("ts")).alias("period"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 10).alias("speed"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") * 37 % 360).cast("double")).alias("wind_from"))
    return op.wind_sectors(hours, 90.0).withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("jn22_snapshots", PARTS, """
with a as (select * from {t} x where seq % 9 <> 0), b as (select seq, case when seq % 13 = 0 then code + 10 else code end code, length from {t} x where seq % 10 <> 0)
select seq, case when a.seq is null then 'not_in_start' when b.seq is null then 'not_in_end' when a.code = b.code and a.length = b.length then 'matching' else 'differs' end state from a full join b using (seq)""")
def _(parts):
    end = parts.where("seq % 10 <> 0").withColumn("code", F.when(F.col("seq") % 13 == 0, F.col("code") + 10).otherwise(F.col("code")))
    return op.snapshots(parts.where("seq % 9 <> 0"), end, "seq", ["code", "length"])


@query("rs12_terrain_obstruction", sql=f"""
with l as (select link_id line, x1, y1, x2, y2, (link_id % 20)::double z1, (link_id % 33)::double z2 from ({fx.plain(fx.LINKS)}) s), p as (select *, i / 10.0::double t from l, (select unnest(range(1, 10)) i)),
q as (select *, floor((x1 + (x2 - x1) * t) / 100)::bigint cx, floor((y1 + (y2 - y1) * t) / 100)::bigint cy, z1 + (z2 - z1) * t ray from p)
select line, count(*) filter ((cx * 7 + cy * 3) % 5 <> 0) seen, round(max(((cx * 7 + cy * 3) % 50)::double - ray) filter ((cx * 7 + cy * 3) % 5 <> 0), 4) excess from q group by 1""")
def _(spark, d):
    links = fx.derived(spark, d, fx.LINKS).select(F.col("link_id").alias("line"), "x1", "y1", "x2", "y2", (F.col("link_id") % 20).cast("double").alias("z1"), (F.col("link_id") % 33).cast("double").alias("z2"))
    terrain = spark.range(5290, 5510).withColumnRenamed("id", "cx").crossJoin(spark.range(1690, 1910).withColumnRenamed("id", "cy"))
    n = F.col("cx") * 7 + F.col("cy") * 3
    terrain = terrain.where(n % 5 != 0).withColumn("z", (n % 50).cast("double"))
    return op.terrain_obstruction(links, terrain).withColumn("excess", F.round("excess", 4))


@query("ag27_one_recording", SURVEYS, """
select pixel group_id, count(*) "rows", min(survey) first_row, case when count(distinct resolution || ':' || (first_day % 2)) = 1 then first(first_day % 2) end "level", case when count(distinct resolution || ':' || (first_day % 2)) = 1 then 'kept' else 'conflicting_identity' end state from {t} x group by 1""")
def _(covers):
    return op.one_recording(covers.select(F.col("pixel").alias("group_id"), F.col("survey").alias("row_id"), F.col("resolution").alias("place"), (F.col("first_day") % 2).alias("level")))
