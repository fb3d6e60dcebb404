"""Queries that join points, links and count points by distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import spatial as op
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

RECEPTORS, LINKS, POINTS = (f"({fx.plain(t)})" for t in (fx.RECEPTORS, fx.LINKS, fx.POINTS))
T = "least(1.0, greatest(0.0, case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) > 0 then ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) else 0.0 end))"
LEN = "sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"
#: Receptors (or points) with every link, t (place along the link) and dist.
RL = f"rl as (select *, sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2)) dist from (select *, {T} t, {LEN} len from {RECEPTORS} r, {LINKS} l) q)"
PL = f"pl as (select *, sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2)) dist from (select p.point_id, p.road_no s_no, p.x, p.y, p.flow p_flow, p.size, l.*, {T} t, {LEN} len from {POINTS} p, {LINKS} l) q)"
ANGLE = "((degrees(atan2(y2-y1, x2-x1)) % 180) + 180) % 180"


def get(spark, d, text):
    return fx.derived(spark, d, text)


def count_points(spark, d):
    return get(spark, d, fx.POINTS).select("point_id", F.col("road_no").alias("s_no"), "x", "y", F.col("flow").alias("p_flow"), "size")


@query("jn4_exposure", sql="with " + RL + """
select receptor_id, count(*) segments, round(min(dist), 4) nearest, round(sum(flow / pow(greatest(dist, 10.0), 2)), 6) benchmark,
  round(sum(flow * greatest(0.0, case when len > 0 then asinh((len - ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/len) / sqrt(pow(((x-x1)*(y2-y1)-(y-y1)*(x2-x1))/len, 2) + 100))
    - asinh(-((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/len / sqrt(pow(((x-x1)*(y2-y1)-(y-y1)*(x2-x1))/len, 2) + 100)) else 0.0 end)), 2) line_energy, count(*) filter (dist <= 250) within_250, count(*) filter (dist <= 500) within_500, count(*) filter (dist <= 1000) within_1000
from rl where dist <= 2000 group by 1""")
def _(spark, d):
    out = op.exposure(get(spark, d, fx.RECEPTORS), get(spark, d, fx.LINKS), 2000.0, within=(250, 500, 1000))
    return out.select("receptor_id", "segments", "within_250", "within_500", "within_1000", F.round("nearest", 4).alias("nearest"), F.round("benchmark", 6).alias("benchmark"), F.round("line_energy", 2).alias("line_energy"))


@query("jn5_nearest_link", sql="with " + RL + """
select receptor_id, first(link_id order by dist, link_id) link_id, round(min(dist), 4) dist from rl where dist <= 5000 group by 1""")
def _(spark, d):
    out = op.nearest(get(spark, d, fx.RECEPTORS), get(spark, d, fx.LINKS), "receptor_id", "link_id", (500.0, 1500.0, 5000.0))
    return out.withColumn("dist", F.round("dist", 4))


@query("jn5_nearest_per_class", sql="with " + RL + """
select receptor_id, road_class, first(link_id order by dist, link_id) link_id, round(min(dist), 4) dist from rl where dist <= 3000 group by 1, 2""")
def _(spark, d):
    out = op.nearest(get(spark, d, fx.RECEPTORS), get(spark, d, fx.LINKS), "receptor_id", "link_id", (3000.0,), ["road_class"])
    return out.withColumn("dist", F.round("dist", 4))


MATCH = f"""s as (select *, ({ANGLE}) angle, (size * 7.0) % 180 s_angle, case when size % 5 = 0 then 'motorway' when size % 5 = 1 then 'a_road' else 'minor' end s_class from pl where dist <= 75),
u as (select *, least(abs(angle - s_angle) % 180, 180 - abs(angle - s_angle) % 180) turn from s),
v as (select *, greatest(0.0, 1 - dist / 75) + case when road_no = s_no then 6 else 0 end + case when road_class = s_class then 2 else -2 end
  + case when turn <= 15 then 1.5 when turn <= 35 then 0.5 else 0 end + case when dist <= 20 then 0.5 else 0 end score from u),
m as (select link_id, point_id, candidates, dist, turn, score, p_flow, road_no, road_class, case when road_no = s_no and road_class = s_class and score >= 8 then 'direct_high_confidence'
  when road_class = s_class and dist <= 25 and turn <= 45 and score >= 3 then 'direct_medium_confidence' else 'imputed' end match_category
  from (select *, count(*) over (partition by link_id) candidates, row_number() over (partition by link_id order by score desc, dist, point_id) n from v) where n = 1)"""


def traffic_sources(spark, d):
    kind = F.when(F.col("size") % 5 == 0, "motorway").when(F.col("size") % 5 == 1, "a_road").otherwise("minor")
    return count_points(spark, d).withColumns({"s_class": kind, "s_angle": F.pmod(F.col("size") * F.lit(7.0), F.lit(180.0))})


@query("jn6_traffic_match", sql="with " + PL + ", " + MATCH + """
select link_id, point_id, candidates, round(dist, 4) dist, round(turn, 4) turn, round(score, 4) score, match_category from m""")
def _(spark, d):
    return op.named_match(get(spark, d, fx.LINKS), traffic_sources(spark, d)).withColumns({c: F.round(c, 4) for c in ("dist", "turn", "score")})


@query("jn7_imputed_flow", sql="with " + PL + ", " + MATCH + f""",
k as (select * from m where match_category <> 'imputed'),
n as (select road_no, median(p_flow) f from k group by 1), c as (select road_class, median(p_flow) f from k group by 1), a as (select median(flow) f from {POINTS} p)
select l.link_id, coalesce(k.p_flow, n.f, c.f, a.f) flow, case when k.p_flow is not null then 'direct' when n.f is not null then 'same_number' when c.f is not null then 'same_class' else 'global' end method
from {LINKS} l left join k using (link_id) left join n on n.road_no = l.road_no left join c on c.road_class = l.road_class, a""")
def _(spark, d):
    links, sources = get(spark, d, fx.LINKS), traffic_sources(spark, d)
    direct = op.named_match(links, sources).where("match_category <> 'imputed'").join(sources.select("point_id", F.col("p_flow").alias("flow")), "point_id").select("link_id", "flow")
    return op.impute(links.select("link_id", "road_no", "road_class"), direct, get(spark, d, fx.POINTS))


@query("jn8_wn3_wn11_count_linkage", sql="with " + PL + f""",
n as (select *, row_number() over (partition by point_id order by dist, link_id) n, lead(dist) over (partition by point_id order by dist, link_id) - dist margin, least(t * len, len - t * len) clearance from pl where dist <= 25),
f as (select * from n where n = 1),
r as (select p.point_id, f.link_id, f.dist, f.clearance, f.margin, case when p.flow <= 200 then 'invalid_traffic' when f.dist is null or f.dist > 10 then 'no_road_within_distance_limit'
  when f.road_class <> 'minor' then 'nearest_road_class_incompatible' when f.clearance < 20 then 'near_link_endpoint_or_junction' when f.margin < 15 then 'competing_road_ambiguous' else 'unique_local_geometric_support' end reason
  from {POINTS} p left join f using (point_id)),
s as (select *, count(*) filter (reason = 'unique_local_geometric_support') over (partition by link_id) k from r)
select point_id, case when reason = 'unique_local_geometric_support' and k = 1 then link_id end accepted_link_id, round(dist, 4) dist, round(clearance, 4) clearance, round(margin, 4) margin,
  case when reason = 'unique_local_geometric_support' and k > 1 then 'multiple_count_points_on_one_link' else reason end reason from s""")
def _(spark, d):
    points = count_points(spark, d).select("point_id", "x", "y", F.col("p_flow").alias("flow"))
    return op.link_counts(points, get(spark, d, fx.LINKS).drop("flow")).withColumns({c: F.round(c, 4) for c in ("dist", "clearance", "margin")})


RING = ((532000.0, 172000.0), (548000.0, 174000.0), (545000.0, 188000.0), (539000.0, 179000.0), (531000.0, 186000.0))


@query("jn9_points_in_polygon", sql=f"""
with e(ax, ay, cx, cy) as (values {", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(RING, [*RING[1:], RING[0]], strict=True))})
select receptor_id, region_id from {RECEPTORS} r, e group by 1, 2 having sum(case when (ay > y) <> (cy > y) and x < (cx - ax) * (y - ay) / (cy - ay) + ax then 1 else 0 end) % 2 = 1""")
def _(spark, d):
    return op.inside(get(spark, d, fx.RECEPTORS), RING).select("receptor_id", "region_id")


@query("jn3_st3_sources_union", sql=f"""
select p.point_id id, 'matched' kind, l.link_id, p.flow from {POINTS} p join {LINKS} l on p.point_id = l.link_id
union all select p.point_id, 'point_only', null, p.flow from {POINTS} p where not exists (select 1 from {LINKS} l where l.link_id = p.point_id)""")
def _(spark, d):
    points, links = get(spark, d, fx.POINTS), get(spark, d, fx.LINKS).select("link_id")
    same = F.col("point_id") == F.col("link_id")
    matched = points.join(links, same).select(F.col("point_id").alias("id"), F.lit("matched").alias("kind"), "link_id", "flow")
    alone = points.join(links, same, "left_anti").select(F.col("point_id").alias("id"), F.lit("point_only").alias("kind"), F.lit(None).cast("long").alias("link_id"), "flow")
    return matched.unionByName(alone)


@query("prj14_orientation", fx.LINKS, f"select link_id, round({ANGLE}, 6) angle, round({LEN}, 4) len from {{t}} x")
def _(links):
    return links.select("link_id", F.round(geo.orientation(*[F.col(c) for c in op.ENDS]), 6).alias("angle"), F.round(geo.length(*op.ENDS), 4).alias("len"))


@query("prj15_link_pieces", fx.LINKS, f"""
with q as (select *, {LEN} len, greatest(1, ceil({LEN} / 25))::int parts from {{t}} x),
k as (select *, unnest(range(0, parts))::int part from q)
select link_id, part, round(len * part / parts, 4) chainage, round(x1 + (x2 - x1) * part / parts, 4) px1, round(y1 + (y2 - y1) * part / parts, 4) py1,
  round(x1 + (x2 - x1) * (part + 1) / parts, 4) px2, round(y1 + (y2 - y1) * (part + 1) / parts, 4) py2 from k""")
def _(links):
    return op.pieces(links, 25.0).withColumns({c: F.round(c, 4) for c in ("chainage", "px1", "py1", "px2", "py2")})


@query("prj16_link_samples", fx.LINKS, """
select link_id, i::int i, round(x1 + (x2 - x1) * (i + 0.5) / 4, 4) x, round(y1 + (y2 - y1) * (i + 0.5) / 4, 4) y from {t} x, (select unnest(range(0, 4)) i)""")
def _(links):
    return op.samples(links, 4).withColumns({c: F.round(c, 4) for c in ("x", "y")})


@query("prj16_spaced_samples", fx.LINKS, f"""
with q as (select *, {LEN} len from {{t}} x), k as (select *, unnest(range(0, floor(len / 30 + 1e-9)::bigint + 1))::int i from q)
select link_id, i, i * 30.0::double chainage, round(x1 + (x2 - x1) * case when len > 0 then least(1.0, i * 30 / len) else 0 end, 4) x, round(y1 + (y2 - y1) * case when len > 0 then least(1.0, i * 30 / len) else 0 end, 4) y from k""")
def _(links):
    return op.spaced_samples(links, 30.0).withColumns({c: F.round(c, 4) for c in ("x", "y")})


PROXY = {"light": (70.0, 30.0, 65.0, 5.0), "hgv": (78.0, 25.0, 80.0, 8.0)}  # rolling level and slope, propulsion level and slope


@query("prj17_relative_emission", fx.LINKS, """
with q as (select *, greatest(20.0, least(130.0, 30.0 + mod(link_id * 17, 120))) v, case road_class when 'motorway' then 1.5 when 'a_road' then 0.5 else -1.0 end k from {t} x)
select link_id, round(10 * log10(greatest(1e-12, greatest(0.0, flow - hgv_flow) * (pow(10, (70 + 30 * log10(v / 70) + k) / 10) + pow(10, (65 + 5 * (v - 70) / 70 + k) / 10))
  + hgv_flow * (pow(10, (78 + 25 * log10(v / 70) + k) / 10) + pow(10, (80 + 8 * (v - 70) / 70 + k) / 10)))), 4) emission_db from q""")
def _(links):
    v = F.greatest(F.lit(20.0), F.least(F.lit(130.0), F.lit(30.0) + F.col("link_id") * 17 % 120))
    k = F.when(F.col("road_class") == "motorway", 1.5).when(F.col("road_class") == "a_road", 0.5).otherwise(-1.0)
    power = lambda p: F.pow(F.lit(10.0), (p[0] + p[1] * F.log10(v / 70) + k) / 10) + F.pow(F.lit(10.0), (p[2] + p[3] * (v - 70) / 70 + k) / 10)
    total = F.greatest(F.lit(0.0), F.col("flow") - F.col("hgv_flow")) * power(PROXY["light"]) + F.col("hgv_flow") * power(PROXY["hgv"])
    return links.select("link_id", F.round(10 * F.log10(F.greatest(F.lit(1e-12), total)), 4).alias("emission_db"))


BOX = (533000.0, 173000.0, 546000.0, 187000.0)


@query("ag17_clipped_length", fx.LINKS, f"""
with c as (select *, {LEN} len, x2 - x1 dx, y2 - y1 dy from {{t}} x where greatest(x1, x2) >= {BOX[0]} and least(x1, x2) <= {BOX[2]} and greatest(y1, y2) >= {BOX[1]} and least(y1, y2) <= {BOX[3]}),
k as (select *, greatest(0.0, coalesce(case when dx > 0 then ({BOX[0]} - x1) / dx when dx < 0 then ({BOX[2]} - x1) / dx end, 0.0), coalesce(case when dy > 0 then ({BOX[1]} - y1) / dy when dy < 0 then ({BOX[3]} - y1) / dy end, 0.0)) lo,
  least(1.0, coalesce(case when dx > 0 then ({BOX[2]} - x1) / dx when dx < 0 then ({BOX[0]} - x1) / dx end, 1.0), coalesce(case when dy > 0 then ({BOX[3]} - y1) / dy when dy < 0 then ({BOX[1]} - y1) / dy end, 1.0)) hi from c)
select road_class, count(*) links, round(sum(len * (hi - lo)), 3) metres, round(sum(len * (hi - lo)) / (select sum(len * (hi - lo)) from k where hi > lo and len > 0), 6) share from k where hi > lo and len > 0 group by 1""")
def _(links):
    from pyspark.sql import Window as W

    own = op.clipped(links, BOX).groupBy("road_class").agg(F.count(F.lit(1)).alias("links"), F.sum("inside_m").alias("m"))
    return own.select("road_class", "links", F.round("m", 3).alias("metres"), F.round(F.col("m") / F.sum("m").over(W.partitionBy()), 6).alias("share"))


@query("ag18_ag49_match_quality", sql="with " + PL + ", " + MATCH + f""",
j as (select l.road_class, coalesce(m.match_category, 'imputed') category, m.dist, {LEN} len from {LINKS} l left join m using (link_id))
select road_class, category, count(*) n, round(count(*) / sum(count(*)) over (partition by road_class), 6) share, round(median(dist), 4) median_dist, round(sum(len), 3) metres from j group by 1, 2""")
def _(spark, d):
    from pyspark.sql import Window as W

    links = get(spark, d, fx.LINKS)
    j = links.withColumn("len", geo.length(*op.ENDS)).join(op.named_match(links, traffic_sources(spark, d)), "link_id", "left")
    out = j.groupBy("road_class", F.coalesce("match_category", F.lit("imputed")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("dist"), 4).alias("median_dist"), F.round(F.sum("len"), 3).alias("metres"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("road_class")), 6))


@query("jn19_one_way_evidence", sql=f"""
with p as (select l.*, i, x1 + (x2 - x1) * (i + 0.5) / 7 x, y1 + (y2 - y1) * (i + 0.5) / 7 y, {ANGLE} heading from {LINKS} l, (select unnest(range(0, 7)) i)),
e as (select link_id e_id, road_no e_no, x1 + 3 ex1, y1 + 4 ey1, x2 + 3 ex2, y2 + 4 ey2 from {LINKS} l where link_id % 3 <> 0),
q as (select p.link_id, p.i, p.x, p.y, p.heading, e.*, least(1.0, greatest(0.0, case when (ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1) > 0 then ((x-ex1)*(ex2-ex1)+(y-ey1)*(ey2-ey1))/((ex2-ex1)*(ex2-ex1)+(ey2-ey1)*(ey2-ey1)) else 0.0 end)) t from p join e on p.road_no = e.e_no),
g as (select *, abs(heading - (((degrees(atan2(ey2-ey1, ex2-ex1)) % 180) + 180) % 180)) % 180 a from q where sqrt(pow(x-(ex1+t*(ex2-ex1)),2)+pow(y-(ey1+t*(ey2-ey1)),2)) <= 10),
c as (select link_id, count(distinct i) n from g where least(a, 180 - a) <= 25 group by 1)
select link_id, coalesce(n, 0) probes, coalesce(n, 0) = 7 supported from {LINKS} l left join c using (link_id)""")
def _(spark, d):
    links = get(spark, d, fx.LINKS)
    shifted = links.where("link_id % 3 <> 0").select(F.col("road_no").alias("e_no"), (F.col("x1") + 3).alias("x1"), (F.col("y1") + 4).alias("y1"), (F.col("x2") + 3).alias("x2"), (F.col("y2") + 4).alias("y2"))
    return op.one_way(links, shifted)


@query("jn23_barrier_crossings", sql=f"""
with p as (select receptor_id path_id, x ax, y ay, x + receptor_id % 700 - 350 cx, y + receptor_id * 3 % 700 - 350 cy from {RECEPTORS} r),
j as (select * from p, {LINKS} l where ((cx-ax)*(y1-ay)-(cy-ay)*(x1-ax))*((cx-ax)*(y2-ay)-(cy-ay)*(x2-ax)) < 0 and ((x2-x1)*(ay-y1)-(y2-y1)*(ax-x1))*((x2-x1)*(cy-y1)-(y2-y1)*(cx-x1)) < 0)
select path_id, count(distinct link_id) crossed, min(link_id) first_link from j group by 1""")
def _(spark, d):
    r = get(spark, d, fx.RECEPTORS)
    paths = r.select(F.col("receptor_id").alias("path_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("receptor_id") % 700 - 350).alias("bx2"), (F.col("y") + F.col("receptor_id") * 3 % 700 - 350).alias("by2"))
    return op.crossings(paths, get(spark, d, fx.LINKS).select("link_id", *op.ENDS))


@query("jn24_assumption_cases", sql=f"""
select link_id, case_id, round(flow * (case when case_id like '%double' then 2.0 when case_id like '%half' then 0.5 else 1.0 end), 4) night_flow from {LINKS} l, (values ('anchor'), ('timing_night_half'), ('timing_night_double')) c(case_id)""")
def _(spark, d):
    cases = spark.createDataFrame([("anchor", 1.0), ("timing_night_half", 0.5), ("timing_night_double", 2.0)], "case_id string, night double")
    return get(spark, d, fx.LINKS).crossJoin(F.broadcast(cases)).select("link_id", "case_id", F.round(F.col("flow") * F.col("night"), 4).alias("night_flow"))


@query("jn20_parallel_links", sql=f"""
with l as (select link_id, x1, y1, x2, y2, (x1 + x2) / 2 mx, (y1 + y2) / 2 my, {LEN} len, {ANGLE} angle from (select * from {LINKS} a union all
  select link_id + 100000, road_no, road_class, x1 + 20, y1 - 15, x2 + 20, y2 - 15, flow, hgv_flow from {LINKS} b where link_id % 2 = 0) u),
j as (select a.link_id, o.link_id o_link_id, a.x1, a.y1, a.x2, a.y2, a.len, o.len o_len, o.mx ox, o.my oy, abs(a.angle - o.angle) % 180 turn,
    ((o.x1 - a.x1) * (a.x2 - a.x1) + (o.y1 - a.y1) * (a.y2 - a.y1)) / a.len p1, ((o.x2 - a.x1) * (a.x2 - a.x1) + (o.y2 - a.y1) * (a.y2 - a.y1)) / a.len p2,
    least(1.0, greatest(0.0, ((o.mx - a.x1) * (a.x2 - a.x1) + (o.my - a.y1) * (a.y2 - a.y1)) / (a.len * a.len))) t
  from l a join l o on a.link_id <> o.link_id and a.len > 0 and o.len > 0),
k as (select *, greatest(0.0, least(greatest(p1, p2), len) - greatest(least(p1, p2), 0.0)) overlap, sqrt(pow(ox - (x1 + t * (x2 - x1)), 2) + pow(oy - (y1 + t * (y2 - y1)), 2)) off from j)
select link_id, o_link_id, round(off, 4) off, round(overlap, 4) overlap from k where least(turn, 180 - turn) <= 20 and off <= 60 and overlap >= 0.5 * len and overlap >= 0.5 * o_len""")
def _(spark, d):
    links = get(spark, d, fx.LINKS)
    twin = links.where("link_id % 2 = 0").select((F.col("link_id") + 100000).alias("link_id"), "road_no", "road_class", (F.col("x1") + 20).alias("x1"), (F.col("y1") - 15).alias("y1"), (F.col("x2") + 20).alias("x2"), (F.col("y2") - 15).alias("y2"), "flow", "hgv_flow")
    return op.parallel(links.unionByName(twin)).withColumns({c: F.round(c, 4) for c in ("off", "overlap")})
