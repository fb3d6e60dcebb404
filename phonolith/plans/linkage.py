"""Counts of minor roads on lines that bend: the whole policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.operators import linkage as op
from phonolith.operators import polylines
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

LINES = f"""
select link_id, part, seq, x, y, road_class, case when mod(link_id, 7) = 3 then 'Dual Carriageway' else 'Single Carriageway' end form_of_way, case when mod(link_id, 11) = 4 then 'Bridge' else '' end structure,
  mod(link_id, 17) = 5 fictitious from ({fx.VERTICES}) v where part = 0
"""
#: What a count of a part holds, from the part and the middle of its edge (x, y), and these middles; the last point of a link has none.
HOLDS = """
p_partkey point_id, x + mod(p_partkey, 9) - 4 x, y + mod(p_partkey, 8) - 4 y, cast(case when mod(p_partkey, 23) = 0 then 2020 else 2021 end as int) as year,
  cast(mod(p_partkey * 7, 900) as double) flow, cast(case when mod(p_partkey, 29) = 0 then -1 else mod(p_partkey, 5) end as double) hgv_flow, case when mod(p_partkey, 19) = 0 then 'Major' else 'Minor' end road_type,
  case when mod(p_partkey, 13) = 0 then 'B4044' when mod(p_partkey, 2) = 0 then ' u' else 'C' end road_name, case when mod(p_partkey, 31) = 0 then 'Modelled' else 'Estimated' end as method
""".strip()
MIDDLES = f"select link_id, seq, (x + lead(x) over w) / 2 x, (y + lead(y) over w) / 2 y from ({LINES}) l window w as (partition by link_id order by seq)"
#: A count a part, beside the middle of an edge of some link.
COUNTED = f"""
select {HOLDS}
from {{part}} join (select x, y, cast(count(*) over () as bigint) total, cast(row_number() over (order by link_id, seq) as bigint) nth
  from ({MIDDLES}) m where x is not null) e on e.nth = 1 + mod(p_partkey * 7919, total)
"""
#: Links whose edges are numbered together.
LINKS_A_BLOCK = 4096
BOUNDS = (530000.0, 170000.0, 549500.0, 189000.0)
P, L = f"({fx.plain(COUNTED)})", f"({fx.plain(LINES)})"


def counted(spark: SparkSession, d: str) -> DataFrame:
    """The rows of COUNTED. Its condition holds the total, so as it stands every part is tried with every edge.

    Here the total is known before the join, which goes by equality, and edges are numbered within blocks of links, after
    a small table of blocks.
    """
    middles = fx.derived(spark, d, MIDDLES).where("x is not null").withColumn("block", F.expr(f"link_id div {LINKS_A_BLOCK}"))
    sizes = middles.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("block").orderBy("link_id", "seq"))
    edges = middles.withColumn("within", within).join(before, F.col("block").eqNullSafe(F.col("b"))).select("x", "y", (F.col("before") + F.col("within")).alias("nth"))
    parts = fx.derived(spark, d, "select * from {part}").crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))
    asked = parts.withColumn("nth", F.expr("1 + mod(p_partkey * 7919, nullif(total, 0))"))
    return spark.sql(f"select {HOLDS} from {{asked}} join {{edges}} using (nth)", asked=asked, edges=edges)


@query("jn8_linkage_policy", sql=f"""
with v as (select *, lead(x) over w x2, lead(y) over w y2, row_number() over w edge from {L} q window w as (partition by link_id order by seq)),
e as (select link_id, edge, x x1, y y1, x2, y2, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) length, any_value(road_class) over (partition by link_id) road_class, form_of_way, structure, fictitious from v where x2 is not null and (x <> x2 or y <> y2)),
k as (select *, sum(length) over (partition by link_id order by edge rows unbounded preceding) - length chainage, row_number() over (partition by link_id order by edge) n from e),
b as (select link_id, sum(length) whole, arg_min(x1, edge) = arg_max(x2, edge) and arg_min(y1, edge) = arg_max(y2, edge) ring from k group by 1),
c as (select distinct a.link_id from k a join k z on z.link_id = a.link_id and z.n > a.n + 1
    and ((a.x2-a.x1)*(z.y1-a.y1)-(a.y2-a.y1)*(z.x1-a.x1)) * ((a.x2-a.x1)*(z.y2-a.y1)-(a.y2-a.y1)*(z.x2-a.x1)) <= 0 and ((z.x2-z.x1)*(a.y1-z.y1)-(z.y2-z.y1)*(a.x1-z.x1)) * ((z.x2-z.x1)*(a.y2-z.y1)-(z.y2-z.y1)*(a.x2-z.x1)) <= 0
    and greatest(a.x1,a.x2) >= least(z.x1,z.x2) and greatest(z.x1,z.x2) >= least(a.x1,a.x2) and greatest(a.y1,a.y2) >= least(z.y1,z.y2) and greatest(z.y1,z.y2) >= least(a.y1,a.y2)
  union select a.link_id from k a join k z on z.link_id = a.link_id and z.n = a.n + 1 and (a.x2-a.x1)*(z.y2-a.y1)-(a.y2-a.y1)*(z.x2-a.x1) = 0 and (a.x2-a.x1)*(z.x2-z.x1)+(a.y2-a.y1)*(z.y2-z.y1) < 0),
t as (select p.point_id, k.*, least(1.0, greatest(0.0, ((p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1))/(length*length))) t, p.x, p.y from {P} p join k on not fictitious and abs(p.x - (x1 + x2) / 2) <= 25 + length and abs(p.y - (y1 + y2) / 2) <= 25 + length),
d as (select *, sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2)) dist from t),
g as (select point_id, link_id, min(dist) dist, first(chainage + t * length order by dist, chainage + t * length) "at", any_value(road_class) road_class, any_value(form_of_way) form_of_way, any_value(structure) structure from d where round(dist, 6) <= 25 group by 1, 2),
n as (select *, row_number() over o i, lead(dist) over o - dist margin, count(*) over (partition by point_id) candidates from g window o as (partition by point_id order by round(dist, 6), link_id)),
f as (select n.*, least("at", whole - "at") clearance, ring or c.link_id is not null bent, n.link_id % 13 = 0 taken from n join b on b.link_id = n.link_id left join c on c.link_id = n.link_id where i = 1),
r as (select p.point_id, f.link_id, f.dist, f.clearance, f.margin, coalesce(f.candidates, 0) candidates,
  case when p."year" <> 2021 or p.flow <= 0 or p.hgv_flow < 0 or p.hgv_flow > p.flow then 'invalid_or_wrong_year_traffic' when p.road_type <> 'Minor' or upper(trim(p.road_name)) not in ('C', 'U') then 'unsupported_minor_road_identity'
    when p."method" not in ('Counted', 'Estimated') then 'unqualified_traffic_quality_flag' when least(p.x - {BOUNDS[0]}, {BOUNDS[2]} - p.x, p.y - {BOUNDS[1]}, {BOUNDS[3]} - p.y) < 25 then 'insufficient_network_margin'
    when f.dist is null or round(f.dist, 6) > 10 then 'no_road_within_distance_limit' when f.road_class <> 'minor' then 'nearest_road_class_incompatible' when f.form_of_way <> 'Single Carriageway' or f.structure <> '' or f.bent then 'carriageway_or_structure_unqualified'
    when f.taken then 'existing_direct_evidence_protected' when round(f.clearance, 6) < 20 then 'near_link_endpoint_or_junction' when round(f.margin, 6) < 15 then 'competing_road_ambiguous' else 'unique_local_geometric_support' end reason from {P} p left join f on f.point_id = p.point_id),
s as (select *, count(*) filter (reason = 'unique_local_geometric_support') over (partition by link_id) times, reason not in ('invalid_or_wrong_year_traffic', 'unsupported_minor_road_identity', 'unqualified_traffic_quality_flag', 'insufficient_network_margin') searched from r),
z as (select *, reason = 'unique_local_geometric_support' and times = 1 good, searched and coalesce(round(dist, 6) <= 10, false) shown from s)
select point_id, case when good then 'accepted_provisional' else 'rejected' end status, case when reason = 'unique_local_geometric_support' and times > 1 then 'multiple_count_points_on_one_link' else reason end reason, case when good then link_id end accepted_link_id,
  case when shown then link_id end proposed_link_id, case when shown then round(dist, 4) end dist, case when shown then round(clearance, 4) end clearance, case when shown then round(margin, 4) end margin, case when searched then candidates end candidates from z""")
def _(spark, d):
    vertices = fx.derived(spark, d, LINES)
    lines = polylines.lines_of(vertices, "road_class", "form_of_way", "structure", "fictitious")
    out = op.link_counts(counted(spark, d), lines, lines.where("link_id % 13 = 0 and not fictitious").select("link_id"), bounds=BOUNDS)
    return out.withColumns({c: F.round(c, 4) for c in ("dist", "clearance", "margin")})
