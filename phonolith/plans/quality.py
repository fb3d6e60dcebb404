"""Queries that check inventories, layouts and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.operators import quality as op
from phonolith.plans.registry import query
from phonolith.sources.fixtures import CELLS


def tiles(cells):
    return cells.select(F.floor(F.col("row_i") / 10).cast("long").alias("row_i"), F.floor(F.col("col_i") / 10).cast("long").alias("col_i")).distinct()


TILES = "t as (select distinct row_i // 10 row_i, col_i // 10 col_i from {t} x)"


@query("st1_st2_inventory", CELLS, "with " + TILES + """,
e as (select row_i * 1000 + col_i tile from t), f as (select tile from e where tile % 7 <> 0 union all select tile from e where tile % 13 = 0 union all select tile + 500 from e where tile % 17 = 0),
g as (select tile, count(*) times from f group by 1)
select tile, case when g.times is null then 'missing' when e.tile is null then 'unexpected' else 'duplicate' end fault, coalesce(g.times, 0) times from e full join g using (tile) where g.times is null or e.tile is null or g.times > 1""")
def _(cells):
    e = tiles(cells).select((F.col("row_i") * 1000 + F.col("col_i")).alias("tile"))
    f = e.where("tile % 7 <> 0").union(e.where("tile % 13 = 0")).union(e.where("tile % 17 = 0").select(F.col("tile") + 500))
    return op.inventory(e, f, "tile")


BOX = "b as (select row_i, col_i, row_i * 1000 + col_i id, col_i * 1000.0::double + case when (row_i + col_i) % 9 = 0 then 100 else 0 end minx, (col_i + 1) * 1000.0::double maxx, -(row_i + 1) * 1000.0::double miny, -row_i * 1000.0::double + case when (row_i * 3 + col_i) % 11 = 0 then 50 else 0 end maxy from t)"


def boxes(cells):
    shift = F.when((F.col("row_i") + F.col("col_i")) % 9 == 0, 100).otherwise(0)
    rise = F.when((F.col("row_i") * 3 + F.col("col_i")) % 11 == 0, 50).otherwise(0)
    return tiles(cells).select("row_i", "col_i", (F.col("row_i") * 1000 + F.col("col_i")).alias("id"), (F.col("col_i") * 1000.0 + shift).alias("minx"), ((F.col("col_i") + 1) * 1000.0).alias("maxx"), (-(F.col("row_i") + 1) * 1000.0).alias("miny"), (-F.col("row_i") * 1000.0 + rise).alias("maxy"))


@query("jn16_tile_layout", CELLS, "with " + TILES + ", " + BOX + """,
g as (select 'horizontal' direction, r.minx - l.maxx gap from b l join b r on l.row_i = r.row_i and r.col_i = l.col_i + 1 union all select 'vertical', u.miny - d.maxy from b u join b d on u.col_i = d.col_i and d.row_i = u.row_i + 1)
select direction, count(*) edges, count(*) filter (gap = 0) sound, count(*) filter (gap > 0) gaps, count(*) filter (gap < 0) "overlaps" from g group by 1""")
def _(cells):
    return op.layout(boxes(cells).drop("id"))


@query("jn15_overlapping_tiles", CELLS, "with " + TILES + ", " + BOX + """
select a.id, o.id o_id from b a join b o on a.id < o.id and least(a.maxx, o.maxx) > greatest(a.minx, o.minx) and least(a.maxy, o.maxy) > greatest(a.miny, o.miny)""")
def _(cells):
    return op.overlapping(boxes(cells).drop("row_i", "col_i"), 700.0)


@query("jn29_ag38_register", CELLS, """
with o as (select source, 'minimum' field, (case when row_i % 40 < 39 or source = 'rail' then 40 else 45 end)::varchar "value" from {t} x union all select source, 'resolution', '10' from {t} x where source <> 'aircraft'),
c(source, field, "value") as (values ('road', 'minimum', '40'), ('rail', 'minimum', '40'), ('aircraft', 'resolution', '10'), ('road', 'resolution', '20')),
a as (select source, field, list_sort(list_distinct(list("value"))) v from o group by 1, 2), b as (select source, field, list_sort(list_distinct(list("value"))) v from c group by 1, 2)
select source, field, coalesce(len(a.v), 0)::int "values", case when a.v is null then 'configured_only' when b.v is null then 'recorded' when len(a.v) > 1 then 'conflicting' when a.v = b.v then 'recorded' else 'conflicting' end state
from a full join b using (source, field)""")
def _(cells):
    value = F.when((F.col("row_i") % 40 < 39) | (F.col("source") == "rail"), "40").otherwise("45")
    seen = cells.select("source", F.lit("minimum").alias("field"), value.alias("value")).union(cells.where("source <> 'aircraft'").select("source", F.lit("resolution"), F.lit("10")))
    known = cells.sparkSession.createDataFrame([("road", "minimum", "40"), ("rail", "minimum", "40"), ("aircraft", "resolution", "10"), ("road", "resolution", "20")], "source string, field string, value string")
    return op.register(seen, known)


@query("jn14_jn30_generations", CELLS, """
with a as (select row_i * 120 + col_i k, sum((raw * 100)::bigint)::bigint s from {t} x where row_i % 50 <> 3 group by 1), b as (select row_i * 120 + col_i k, sum((raw * 100)::bigint)::bigint + case when col_i = 7 then 1 else 0 end s from {t} x where row_i % 50 <> 5 group by 1, col_i)
select k, case when a.s is null then 'unknown' when b.s is null then 'missing' else 'contradicting' end reason from a full join b using (k) where a.s is distinct from b.s""")
def _(cells):
    k = (F.col("row_i") * 120 + F.col("col_i")).alias("k")
    total = F.sum(F.rint(F.col("raw") * 100).cast("long"))
    a = cells.where("row_i % 50 <> 3").groupBy(k).agg(total.alias("s"))
    b = cells.where("row_i % 50 <> 5").groupBy(k, "col_i").agg(total.alias("t")).select("k", (F.col("t") + F.when(F.col("col_i") == 7, 1).otherwise(0)).alias("s"))
    return op.contradictions(a, b, "k", ["s"])


@query("jn12_component_neighbours", CELLS, """
with m as (select row_i, col_i from {t} x where source = 'road' and raw > 0 and raw < 52)
select m.row_i, m.col_i, count(n.row_i) neighbours, bool_or(m.row_i = 0 or m.col_i in (0, 119)) touches_edge from m left join m n on abs(m.row_i - n.row_i) + abs(m.col_i - n.col_i) = 1 group by 1, 2""")
def _(cells):
    m = cells.where("source = 'road' and raw > 0 and raw < 52").select("row_i", "col_i")
    steps = F.explode(F.array(*[F.struct((F.col("row_i") + r).alias("r"), (F.col("col_i") + c).alias("c")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    there = m.select("row_i", "col_i", steps.alias("s")).select("row_i", "col_i", "s.r", "s.c")
    hit = there.join(m.select(F.col("row_i").alias("r"), F.col("col_i").alias("c"), F.lit(1).alias("one")), ["r", "c"], "left")
    edge = (F.col("row_i") == 0) | F.col("col_i").isin(0, 119)
    return hit.groupBy("row_i", "col_i").agg(F.count("one").alias("neighbours")).withColumn("touches_edge", edge)


@query("jn10_jn11_land_mask", CELLS, """
with f as (select row_i // 5 row_b, col_i // 5 col_b, bool_or((row_i * 7 + col_i * 3) % 100 < 4) land from {t} x where source = 'road' group by 1, 2)
select source, count(*) cells, count(*) filter (raw > 0) reported from {t} x join f on f.row_b = row_i // 5 and f.col_b = col_i // 5 and f.land group by 1""")
def _(cells):
    block = [F.floor(F.col(c) / 5).cast("long").alias(c.replace("_i", "_b")) for c in ("row_i", "col_i")]
    fine = cells.where("source = 'road'").select(*block, ((F.col("row_i") * 7 + F.col("col_i") * 3) % 100 < 4).alias("land"))
    land = fine.groupBy("row_b", "col_b").agg(F.bool_or("land").alias("land")).where("land")
    kept = cells.select("*", *block).join(land, ["row_b", "col_b"], "left_semi")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("raw") > 0).alias("reported"))


@query("snk5_fingerprint", CELLS, """
with h as (select source, sha256(row_i || '|' || col_i || '|' || raw) h from {t} x),
s as (select source, count(*) n, sum(('0x' || substr(h, 1, 12))::bigint) p0, sum(('0x' || substr(h, 13, 12))::bigint) p1, sum(('0x' || substr(h, 25, 12))::bigint) p2 from h group by 1)
select source, n, left(sha256(n || ':' || p0 || ':' || p1 || ':' || p2), 16) digest from s""")
def _(cells):
    return op.fingerprint(cells, "source", ["row_i", "col_i", "raw"])
