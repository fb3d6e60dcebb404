"""Queries about traffic, carriageways, air and ground along roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import models, roads
from phonolith.operators.temporal import period_of
from phonolith.plans.registry import query
from phonolith.plans.scenes import PARTS
from phonolith.sources import fixtures as fx

TILES = """
select i * 1000 + j tile_id, cast(i * 5000 - case when mod(i + j, 4) = 0 then 100 else 0 end as double) minx, cast(j * 5000 as double) miny, cast((i + 1) * 5000 as double) maxx, cast((j + 1) * 5000 as double) maxy
from (select distinct cast(floor((530000+mod(c_custkey*15485863,20000)) / 5000.0) as bigint) i, cast(floor((170000+mod(c_custkey*32452843,20000)) / 5000.0) as bigint) j from {customer}) q where mod(i * 7 + j, 6) <> 0
"""


@query("jn2_owning_tile", sql=f"""
with o as (select r.receptor_id, count(*) n, min(tile_id) tile_id from ({fx.plain(fx.RECEPTORS)}) r join ({fx.plain(TILES)}) t on x >= minx and x < maxx and y > miny and y <= maxy group by 1)
select r.receptor_id, case when n = 1 then tile_id end tile_id, case when n is null then 'no_tile' when n = 1 then 'owned' else 'ambiguous' end state from ({fx.plain(fx.RECEPTORS)}) r left join o using (receptor_id)""")
def _(spark, d):
    return roads.tile_of(fx.derived(spark, d, fx.RECEPTORS), fx.derived(spark, d, TILES), 5000.0, "receptor_id")


@query("prj12_grid_and_back", fx.RECEPTORS, "select receptor_id, round(x, 1) x, round(y, 1) y, true round_trip from {t} q")
def _(points):
    """Out to longitude and latitude and back again: where each point started, and whether it came back to within a millimetre."""
    out = geo.with_grid(geo.wgs84_from_grid(points, "x", "y"), "lon", "lat")
    back = (F.abs(F.col("easting") - F.col("x")) < 1e-3) & (F.abs(F.col("northing") - F.col("y")) < 1e-3)
    return out.select("receptor_id", F.round("easting", 1).alias("x"), F.round("northing", 1).alias("y"), back.alias("round_trip"))


@query("src3_known_traffic", fx.LINKS, "select link_id, flow, round(least(1.0, greatest(0.0, coalesce(hgv_flow * (case when link_id % 9 = 0 then 40 else 1 end) / flow, 0.0))), 6) hgv_share from {t} x where flow > 0 and link_id % 11 <> 0")
def _(links):
    rows = links.withColumns({"hgv_flow": F.when(F.col("link_id") % 9 == 0, F.col("hgv_flow") * 40).otherwise(F.col("hgv_flow")), "flow": F.when(F.col("link_id") % 11 == 0, 0.0).otherwise(F.col("flow"))})
    return roads.known_traffic(rows).select("link_id", "flow", F.round("hgv_share", 6).alias("hgv_share"))


#: A speed sheet: a row per road type, year and unit, a column per vehicle.
SHEET = """
select n_name road_type, 2019 + mod(n_nationkey, 3) as year, case when mod(n_nationkey, 2) = 0 then 'mph' else 'kmh' end units, cast(40 + mod(n_nationkey * 7, 31) as double) car, cast(38 + mod(n_nationkey * 5, 29) as double) van, case when mod(n_nationkey, 4) = 0 then null else cast(35 + mod(n_nationkey * 3, 23) as double) end hgv
from {nation}
"""


@query("src8_speed_rows", SHEET, "select road_type, vehicle, mph from (unpivot (select road_type, car, van, hgv from {t} x where year = 2021 and units = 'mph') on car, van, hgv into name vehicle value mph) union all select road_type, 'hgv', null from {t} y where year = 2021 and units = 'mph' and hgv is null")
def _(sheet):
    return roads.speed_rows(sheet, ("car", "van", "hgv"), 2021, "mph")


@query("src9_links_in_box", fx.LINKS, "select link_id, floor((x1 + x2) / 2 / 10000)::bigint square_x, floor((y1 + y2) / 2 / 10000)::bigint square_y from {t} x where greatest(x1, x2) >= 534000 and least(x1, x2) <= 541000 and greatest(y1, y2) >= 174000 and least(y1, y2) <= 183000")
def _(links):
    return roads.in_box(roads.with_box(links), 534000.0, 174000.0, 541000.0, 183000.0).select("link_id", "square_x", "square_y")


AREAS = f"(select link_id, case when mod(link_id, 3) = 0 then null else road_no end road_no, road_class, case when mod(link_id, 4) < 2 then 'urban' else 'rural' end area, x1, y1, x2, y2, flow from ({fx.plain(fx.LINKS)}) q)"
DIRECT = "mod(link_id, 7) = 1 and road_class <> 'motorway'"


@query("jn7_donor_imputation", sql=f"""
with l as {AREAS}, k as (select * from l where {DIRECT}), src as (select case when mod(point_id, 3) = 0 then 'minor' else 'a_road' end road_class, flow from ({fx.plain(fx.POINTS)}) q),
n as (select road_no, median(flow) f, count(*) n from k where road_no is not null group by 1),
d as (select l.link_id, k.flow, k.link_id donor, k.x1, k.y1, k.x2, k.y2, (l.x1 + l.x2) / 2 x, (l.y1 + l.y2) / 2 y from l join k on l.road_class = k.road_class where l.link_id not in (select link_id from k) and (l.road_no is null or l.road_no not in (select road_no from n))),
t as (select *, case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) > 0 then least(1.0, greatest(0.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) else 0.0 end t from d),
r as (select *, row_number() over (partition by link_id order by dist, donor) i from (select *, sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2)) dist from t) q where dist <= 5000),
near as (select link_id, median(flow) f, count(*) n from r where i <= 25 group by 1),
a as (select road_class, area, median(flow) f, count(*) n from k group by 1, 2), c as (select road_class, median(flow) f, count(*) n from k group by 1), s as (select road_class, median(flow) f, count(*) n from src group by 1), e as (select median(flow) f, count(*) n from src)
select l.link_id, coalesce(k.flow, n.f, near.f, a.f, c.f, s.f, e.f) flow,
  case when k.flow is not null then 'direct' when n.f is not null then 'same_number' when near.f is not null then 'near_same_class' when a.f is not null then 'class_and_area' when c.f is not null then 'class' when s.f is not null then 'class_of_all_sources' else 'all_sources' end "method",
  case when k.flow is not null then 1 when n.f is not null then n.n when near.f is not null then near.n when a.f is not null then a.n when c.f is not null then c.n when s.f is not null then s.n else e.n end support
from l left join k on k.link_id = l.link_id left join n on n.road_no = l.road_no left join near on near.link_id = l.link_id left join a on a.road_class = l.road_class and a.area = l.area left join c on c.road_class = l.road_class left join s on s.road_class = l.road_class, e""")
def _(spark, d):
    links = fx.derived(spark, d, fx.LINKS)
    links = links.withColumns({"road_no": F.when(F.col("link_id") % 3 != 0, F.col("road_no")), "area": F.when(F.col("link_id") % 4 < 2, "urban").otherwise("rural")})
    sources = fx.derived(spark, d, fx.POINTS).select(F.when(F.col("point_id") % 3 == 0, "minor").otherwise("a_road").alias("s_class"), "flow")
    return roads.imputed_traffic(links.drop("flow"), links.where(DIRECT).select("link_id", "flow"), sources)


ONE_WAY = f"(select link_id e_id, road_no e_no, case when mod(link_id, 4) = 0 then -1 else 1 end e_sign, case when mod(link_id, 5) = 0 then x2 else x1 end + 3 ex1, case when mod(link_id, 5) = 0 then y2 else y1 end + 4 ey1, case when mod(link_id, 5) = 0 then x1 else x2 end + 3 ex2, case when mod(link_id, 5) = 0 then y1 else y2 end + 4 ey2 from ({fx.plain(fx.LINKS)}) q where mod(link_id, 3) <> 0)"


@query("jn19_one_way_signs", sql=f"""
with l as (select * from ({fx.plain(fx.LINKS)}) q), e as {ONE_WAY},
p as (select link_id, road_no, 'cover' kind, i, x1 + (x2 - x1) * (i / 40.0::double) x, y1 + (y2 - y1) * (i / 40.0::double) y, x2 - x1 lx, y2 - y1 ly from l, (select unnest(range(0, 41)) i) union all
  select link_id, road_no, 'probe', i, x1 + (x2 - x1) * (0.05 + 0.9 * i / 6.0::double), y1 + (y2 - y1) * (0.05 + 0.9 * i / 6.0::double), x2 - x1, y2 - y1 from l, (select unnest(range(0, 7)) i)),
q as (select *, case when (ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1) > 0 then least(1.0, greatest(0.0, ((x-ex1)*(ex2-ex1)+(y-ey1)*(ey2-ey1))/((ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1)))) else 0.0 end t from p join e on road_no = e_no),
g as (select *, min(dist) over (partition by link_id, kind, i) least_d from (select *, sqrt(pow(x-(ex1+t*(ex2-ex1)),2)+pow(y-(ey1+t*(ey2-ey1)),2)) dist from q) z where dist <= 10),
c as (select link_id, count(distinct i) / 41.0::double covered from g where kind = 'cover' group by 1),
v as (select *, (lx*(ex2-ex1)+ly*(ey2-ey1)) / nullif(sqrt(lx*lx+ly*ly) * sqrt((ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1)), 0) co from g where kind = 'probe' and dist <= least_d + 2),
s as (select link_id, count(distinct i) probes, count(*) filter (abs(co) < cos(radians(25.0))) turned, min(sign(co) * e_sign) low, max(sign(co) * e_sign) high from v group by 1),
r as (select l.link_id, covered, low, case when covered is null then 'no_line' when covered < 0.95 then 'not_covered' when coalesce(probes, 0) < 7 then 'probe_without_line' when turned > 0 or low is null then 'headings_differ' when low <> high then 'signs_differ' else 'supported' end status from l left join c using (link_id) left join s using (link_id))
select link_id, round(coalesce(covered, 0), 6) covered, status, case when status = 'supported' then low::int end sign from r""")
def _(spark, d):
    links = fx.derived(spark, d, fx.LINKS)
    turned = F.col("link_id") % 5 == 0
    ends = {a: F.when(turned, F.col(b)).otherwise(F.col(a)) + s for a, b, s in (("x1", "x2", 3), ("y1", "y2", 4), ("x2", "x1", 3), ("y2", "y1", 4))}
    lines = links.where("link_id % 3 <> 0").select(F.col("link_id").alias("e_id"), F.col("road_no").alias("e_no"), F.when(F.col("link_id") % 4 == 0, -1).otherwise(1).alias("e_sign"), *[c.alias(k) for k, c in ends.items()])
    return roads.one_way_signs(links, lines).withColumn("covered", F.round("covered", 6))


NETWORK = """
select s_suppkey link_id, cast(floor(s_suppkey / 4.0) as bigint) road_no, case when mod(s_suppkey, 13) = 0 then null else cast(floor(s_suppkey / 2.0) as bigint) end donor,
  case when mod(cast(floor(s_suppkey / 2.0) as bigint), 3) = 0 then 'dual' when mod(s_suppkey, 17) = 0 then 'other' when mod(s_suppkey, 5) = 0 then 'collapsed' else 'single' end form,
  mod(s_suppkey, 19) = 0 structure, mod(s_suppkey, 23) = 0 fictitious, case when mod(s_suppkey, 11) = 0 then null when mod(cast(floor(s_suppkey / 2.0) as bigint), 3) = 0 then case when mod(s_suppkey, 2) = 0 then 1 else -1 end when mod(s_suppkey, 7) = 0 then 1 end sign
from {supplier}
"""
BUDGETS = """
select distinct cast(floor(s_suppkey / 2.0) as bigint) donor, case mod(cast(floor(s_suppkey / 2.0) as bigint), 5) when 0 then 'single' when 1 then 'residual_too_large' when 2 then 'combined' else 'paired' end status,
  100 + cast(floor(s_suppkey / 2.0) as bigint) forward, case when mod(cast(floor(s_suppkey / 2.0) as bigint), 5) = 0 then null else 200 + cast(floor(s_suppkey / 2.0) as bigint) * 3 end backward
from {supplier}
"""
BESIDE = """
select s_suppkey link_id, case when mod(s_suppkey, 2) = 0 then s_suppkey + 1 else s_suppkey - 1 end o_link_id, cast(2 + mod(cast(floor(s_suppkey / 2.0) as bigint) * 11, 90) as double) off
from {supplier} where mod(cast(floor(s_suppkey / 2.0) as bigint), 4) <> 1
"""


@query("jn21_carriageways", sql=f"""
with l as ({fx.plain(NETWORK)}), b as ({fx.plain(BUDGETS)}), p as ({fx.plain(BESIDE)}),
tw as (select p.link_id, count(*) n from p join l a on a.link_id = p.link_id join l o on o.link_id = p.o_link_id where a.road_no = o.road_no and o.form <> 'other' group by 1),
w as (select l.*, b.status, b.forward, b.backward, coalesce(tw.n, 0) twins from l left join b using (donor) left join tw on tw.link_id = l.link_id),
f as (select *, case when donor is null or status is null then 'no_count' when fictitious then 'not_a_real_line' when structure then 'structure' when form = 'other' then 'special_form' when status not in ('paired', 'combined', 'single') then 'count_not_usable'
  when form = 'dual' and status <> 'paired' then 'dual_needs_both_directions' when form = 'dual' and sign is null then 'dual_without_one_way_evidence' when form = 'dual' then 'dual' when status = 'single' then 'one_direction_is_not_one_way'
  when form = 'single' and sign is not null and status = 'paired' then 'counts_contradict_one_way' when twins > 0 then 'another_line_beside' else 'centreline' end reason from w),
du as (select donor, count(*) members, count(distinct sign) signs, min(link_id) a, max(link_id) b, max(twins) most_twins from f where reason = 'dual' group by 1),
pr as (select du.donor, case when members <> 2 or signs <> 2 then 'dual_not_a_pair' when p.off is null or p.off < 3 or p.off > 80 or most_twins > 1 then 'dual_pair_ambiguous' else 'dual_pair' end pair from du left join p on p.link_id = du.a and p.o_link_id = du.b),
o as (select f.* exclude (reason), case when reason = 'dual' then pair else reason end reason from f left join pr using (donor))
select link_id, reason, case when reason = 'centreline' then coalesce(forward, 0) + coalesce(backward, 0) when reason = 'dual_pair' then case when sign > 0 then forward else backward end end flow from o""")
def _(spark, d):
    return roads.carriageways(*(fx.derived(spark, d, t) for t in (NETWORK, BUDGETS, BESIDE)))


HOURS = "(select event_id, case when hour(ts) between 7 and 18 then 'day' when hour(ts) between 19 and 22 then 'evening' else 'night' end period, 1.0::double + event_id % 5 weight, event_id % 6 <> 0 reported, case when event_id % 6 <> 0 and event_id % 10 <> 0 then event_id % 80 - 25.0::double end t, case when event_id % 6 <> 0 and event_id % 7 <> 0 then event_id % 110::double end rh, case when event_id % 6 <> 0 and event_id % 9 <> 0 then 45.0::double + event_id % 70 end p from events)"
AIR = f"""h as {HOURS}, g as (select *, coalesce(t between -20 and 50, false) gt, coalesce(p between 50 and 120, false) gp from h), k as (select *, gt and coalesce(rh between 10 and 100, false) gr from g),
a as (select *, case when gt then t else 10.0 end temperature_c, case when gr then rh else 70.0 end humidity, case when gp then p else 101.325 end pressure_kpa, case when t is null and rh is null and p is null then 'reference' when gt and gr and gp then 'station' else 'in_part' end status from k)"""


def hours_with_air(spark, d):
    e, n = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    told = n % 6 != 0
    air = roads.chosen_air(F.when(told & (n % 10 != 0), (n % 80 - 25).cast("double")), F.when(told & (n % 7 != 0), (n % 110).cast("double")), F.when(told & (n % 9 != 0), (45 + n % 70).cast("double")))
    return e.select("event_id", period_of(F.hour("ts")).alias("period"), (1 + n % 5).cast("double").alias("weight"), told.alias("reported"), air.alias("air"))


@query("prj20_chosen_air", sql=f"with {AIR} select event_id, temperature_c, humidity, pressure_kpa, case when gt then 'station' else 'reference' end temperature_c_basis, case when gr then 'station' else 'reference' end humidity_basis, case when gp then 'station' else 'reference' end pressure_kpa_basis, status from a")
def _(spark, d):
    return hours_with_air(spark, d).select("event_id", "air.*")


@query("ag47_air_coverage", sql=f"""with {AIR},
f as (select *, (temperature_c + 273.15) / 293.15 r, pressure_kpa / 101.325 q from a), x as (select *, humidity * 101.325 * pow(10, -6.8346 * pow(273.16 / (temperature_c + 273.15), 1.261) + 4.6151) / pressure_kpa h1 from f),
y as (select *, q * (24 + 40400 * h1 * (0.02 + h1) / (0.391 + h1)) o, q * pow(r, -0.5) * (9 + 280 * h1 * exp(-4.17 * (pow(r, -1.0::double / 3) - 1))) n from x),
z as (select *, 1000 * 8.686 * 1e6 * (1.84e-11 / q * sqrt(r) + pow(r, -2.5) * (0.01275 * exp(-2239.1 / (temperature_c + 273.15)) / (o + 1e6 / o) + 0.1068 * exp(-3352 / (temperature_c + 273.15)) / (n + 1e6 / n))) alpha from y)
select period, count(*) "hours", count(*) filter (reported) reported, count(*) filter (status = 'station') station_hours, count(*) filter (not gt) temperature_c_gaps, count(*) filter (not gr) humidity_gaps, count(*) filter (not gp) pressure_kpa_gaps, round(-10 * log10(sum(weight * pow(10, -alpha / 10)) / sum(weight)), 6) loss_db from z group by 1""")
def _(spark, d):
    return roads.air_coverage(hours_with_air(spark, d)).withColumn("loss_db", F.round("loss_db", 6))


@query("prj24_ground_cases", PARTS, """
with c(case_id, uniform, g) as (values ('open', false, 0.5::double), ('hard', true, 0.0::double), ('soft', true, 1.0::double)), p as (select path, case when seq % 97 = 0 then null when code = 70 then 75 else code end code, length from {t} x),
b as (select *, case when code is null or code not in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100) then 'missing' when uniform then 'uniform' when code in (30, 40) then 'porous' when code in (50, 80) then 'hard' else 'unstated' end basis from p, c),
f as (select *, case basis when 'porous' then 1.0 when 'hard' then 0.0 when 'missing' then null else g end factor from b)
select path, case_id, sum(length) length, coalesce(sum(length) filter (basis = 'porous'), 0) porous_m, coalesce(sum(length) filter (basis = 'hard'), 0) hard_m, coalesce(sum(length) filter (basis = 'unstated'), 0) unstated_m, coalesce(sum(length) filter (basis = 'missing'), 0) missing_m,
  round(case when count(*) filter (basis = 'missing') = 0 then sum(factor * length) / sum(length) end, 6) ground from f group by 1, 2""")
def _(parts):
    cases = parts.sparkSession.createDataFrame([("open", False, 0.5), ("hard", True, 0.0), ("soft", True, 1.0)], "case_id string, uniform boolean, g double")
    code = F.when(F.col("seq") % 97 != 0, F.when(F.col("code") == 70, 75).otherwise(F.col("code")))
    return roads.ground_cases(parts.select("path", code.alias("code"), "length"), cases).withColumn("ground", F.round("ground", 6))


@query("jn31_road_context", sql=f"""
with l as (select * from ({fx.plain(fx.LINKS)}) q), w as (select link_id way_id, case link_id % 6 when 0 then 'bridge' when 1 then 'no' end structure, case when link_id % 4 <> 0 then case link_id % 3 when 0 then 'asphalt' else 'paved' end end surface, x1 + 1 ex1, y1 + 2 ey1, x2 + 1 + case when link_id % 5 = 0 then 300 else 0 end ex2, y2 + 2 ey2 from l where link_id % 7 <> 0),
p as (select link_id, i, x1 + (x2 - x1) * (i / 20.0::double) x, y1 + (y2 - y1) * (i / 20.0::double) y from l, (select unnest(range(0, 21)) i)),
j as (select p.link_id, w.*, x, y, case when (ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1) > 0 then least(1.0, greatest(0.0, ((x-ex1)*(ex2-ex1)+(y-ey1)*(ey2-ey1))/((ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1)))) else 0.0 end t from p join w on x between least(ex1, ex2) - 3 and greatest(ex1, ex2) + 3 and y between least(ey1, ey2) - 3 and greatest(ey1, ey2) + 3),
n as (select distinct link_id, way_id, structure, surface from j where sqrt(pow(x-(ex1+t*(ex2-ex1)),2)+pow(y-(ey1+t*(ey2-ey1)),2)) <= 3),
a as (select link_id, count(*) ways, array_to_string(list_sort(list(distinct surface) filter (surface is not null)), ',') surfaces, bool_or(coalesce(structure <> 'no', false)) s from n group by 1)
select l.link_id, coalesce(ways, 0) ways, coalesce(surfaces, '') surfaces, case when s then 'withheld' else 'at_grade_assumed' end status from l left join a using (link_id)""")
def _(spark, d):
    links, n = fx.derived(spark, d, fx.LINKS), F.col("link_id")
    ways = links.where("link_id % 7 <> 0").select(
        n.alias("way_id"), F.when(n % 6 == 0, "bridge").when(n % 6 == 1, "no").alias("structure"), F.when(n % 4 != 0, F.when(n % 3 == 0, "asphalt").otherwise("paved")).alias("surface"),
        (F.col("x1") + 1).alias("x1"), (F.col("y1") + 2).alias("y1"), (F.col("x2") + 1 + F.when(n % 5 == 0, 300).otherwise(0)).alias("x2"), (F.col("y2") + 2).alias("y2"),
    )
    return roads.road_context(links, ways)


GRIDS = """
select tile, source, cast(10 as bigint) t_cols, cast(10 as bigint) t_rows, cast(col_t * 100 as double) t_west, cast(-row_t * 100 as double) t_north, cast(10 as double) t_res,
  cast(10 + case when mod(n, 7) = 1 then 1 when mod(n, 11) = 2 then -2 else 0 end as bigint) r_cols, cast(10 + case when mod(n, 7) = 1 then 1 when mod(n, 13) = 3 then -3 else 0 end as bigint) r_rows,
  cast(col_t * 100 + case when mod(n, 17) = 4 then 30 else 0 end as double) r_west, cast(-row_t * 100 - case when mod(n, 19) = 5 then 20 else 0 end as double) r_north, case when mod(n, 7) = 1 then cast(100 as double) / 11 else cast(10 as double) end r_res, mod(n, 23) <> 0 same_crs
from (select distinct cast(floor(row_i / 10.0) as bigint) row_t, cast(floor(col_i / 10.0) as bigint) col_t, cast(floor(row_i / 10.0) as bigint) * 12 + cast(floor(col_i / 10.0) as bigint) tile, source, cast(floor(row_i / 10.0) as bigint) * 12 + cast(floor(col_i / 10.0) as bigint) + length(source) n from ({cells}) c) q
""".replace("{cells}", fx.CELLS)


@query("ag39_grid_audit", GRIDS, """
with g as (select *, r_cols = t_cols and r_rows = t_rows shape, abs(r_res - t_res) <= 1e-6 res, abs(r_west - t_west) <= 1e-6 and abs(r_north - t_north) <= 1e-6 origin,
  (select count(*) from range(0, t_cols) i where t_west + (i.range + 0.5) * t_res between r_west - 1e-7 and r_west + r_cols * r_res + 1e-7) ax, (select count(*) from range(0, t_rows) i where t_north - (i.range + 0.5) * t_res between r_north - r_rows * r_res - 1e-7 and r_north + 1e-7) dy from {t} x)
select tile, source, case when not same_crs then 'crs' when not res then 'resolution' when not shape then 'dimensions' when not origin then 'bounds' else 'none' end fault,
  case when not same_crs then 'another_crs' when shape and res and origin then 'as_asked' when not res and r_cols = t_cols + 1 and r_rows = t_rows + 1 then 'stretched_by_one' when res and shape then 'shifted' when res and r_cols <= t_cols and r_rows <= t_rows and origin then 'clipped_at_far_edges' when res and r_cols <= t_cols and r_rows <= t_rows then 'clipped' else 'other' end pattern,
  case when same_crs then ax * dy end supported, t_cols * t_rows - case when same_crs then ax * dy end unsupported from g""")
def _(grids):
    return roads.grid_audit(grids)


@query("ml5_least_squares", sql="""
with r as (select c_custkey "key", cast(mod(c_custkey * 37, 6000) as double) / 100 observed, cast(mod(c_custkey * 37, 6000) + mod(c_custkey * 101, 900) - 450 as double) / 100 feature from customer),
f as (select regr_slope(observed, feature) b, regr_intercept(observed, feature) a from r where observed > 20)
select "key", round(a + b * feature, 4) fitted from r, f""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 37 % 6000 / 100).alias("observed"), ((F.col("c_custkey") * 37 % 6000 + F.col("c_custkey") * 101 % 900 - 450) / 100).alias("feature"))
    beta = models.least_squares(rows.where("observed > 20"), ["feature"], "observed")
    return rows.select("key", F.round(float(beta[0]) + float(beta[1]) * F.col("feature"), 4).alias("fitted"))


@query("st7_key_membership", PARTS, """
with a as (select distinct path * 100 + code k from {t} x where seq % 3 <> 0), b as (select distinct path * 100 + code k from {t} x where seq % 4 <> 0)
select k, case when a.k is null then 'right' when b.k is null then 'left' else 'both' end side from a full join b using (k)""")
def _(parts):
    k = (F.col("path") * 100 + F.col("code")).alias("k")
    return roads.membership(parts.where("seq % 3 <> 0").select(k), parts.where("seq % 4 <> 0").select(k), "k")
