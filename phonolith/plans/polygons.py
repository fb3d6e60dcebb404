"""Queries over polygons with holes and islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import polygons as op
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

#: Stars around 25 places; every second has a hole, every fourth an island in it.
SHAPES = """
select n_nationkey polygon_id, ring, seq, cast(533000 + mod(n_nationkey * 7919, 14000) + floor(cos(6.283185307179586 * seq / corners) * (size + mod(n_nationkey * 97 + seq * 53, half)) + 0.25) as double) x,
  cast(173000 + mod(n_nationkey * 104729, 14000) + floor(sin(6.283185307179586 * seq / corners) * (size + mod(n_nationkey * 97 + seq * 53, half)) + 0.25) as double) y
from {nation} cross join (values (0, 12, 900, 1200), (1, 6, 300, 250), (2, 4, 60, 90)) r(ring, corners, size, half) cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) s(seq)
where seq < corners and (ring = 0 or ring = 1 and mod(n_nationkey, 2) = 0 or ring = 2 and mod(n_nationkey, 4) = 0)
"""
S = f"({fx.plain(SHAPES)})"
SIDES = f"""o as (select polygon_id, x ux, y uy, coalesce(lead(x) over w, first(x) over w) vx, coalesce(lead(y) over w, first(y) over w) vy from {S} q window w as (partition by polygon_id, ring order by seq rows between unbounded preceding and unbounded following)),
s as (select polygon_id, case when uy < vy then ux else vx end ax, least(uy, vy) ay, case when uy < vy then vx else ux end cx, greatest(uy, vy) cy from o)"""
HIT = "case when (ay > y) <> (cy > y) and x < (cx - ax) * (y - ay) / (cy - ay) + ax then 1 else 0 end"


def shapes(spark, d):
    return op.polygons_of(fx.derived(spark, d, SHAPES))


@query("jn9_points_in_polygons", sql=f"""with {SIDES}
select receptor_id, polygon_id from ({fx.plain(fx.RECEPTORS)}) r, s group by 1, 2 having sum({HIT}) % 2 = 1""")
def _(spark, d):
    return op.inside(fx.derived(spark, d, fx.RECEPTORS), shapes(spark, d), "receptor_id")


@query("jn9_lonlat_box")
def _(spark, d):
    """Receptors within a box of longitudes and latitudes, whose sides are bent on the grid: cut into short pieces, then projected."""
    box = spark.createDataFrame([("box", [[(-0.10, 51.42), (0.05, 51.42), (0.05, 51.55), (-0.10, 51.55)]])], "polygon_id string, rings array<array<struct<x:double,y:double>>>")
    corners = op.densified(box, 0.005).select("polygon_id", F.posexplode(F.expr("rings[0]")).alias("seq", "p")).select("polygon_id", F.lit(0).alias("ring"), "seq", "p.x", "p.y")
    outline = geo.with_grid(corners, "x", "y").select("polygon_id", "ring", "seq", F.col("easting").alias("x"), F.col("northing").alias("y"))
    return op.inside(fx.derived(spark, d, fx.RECEPTORS), op.polygons_of(outline), "receptor_id").select("receptor_id")


LAND = f"""{SIDES},
b as (select polygon_id, min(least(ax, cx)) w, max(greatest(ax, cx)) e, min(ay) l, max(cy) h from s group by 1),
g as (select polygon_id, (c.range + 0.5) * 20 x, r y from (select *, (unnest(range(floor(l / 20)::bigint, ceil(h / 20)::bigint + 1)) + 0.5) * 20 r from b) k, range(26500, 27600) c where c.range * 20 between w - 40 and e + 40),
i as (select distinct x, y from (select g.polygon_id, x, y from g join s using (polygon_id) group by 1, 2, 3 having sum({HIT}) % 2 = 1) p),
m as (select floor(y / 100)::bigint row_i, floor(x / 100)::bigint col_i, count(*) middles from i group by 1, 2)"""


@query("jn11_land_cells", sql=f"with {LAND} select * from m")
def _(spark, d):
    return op.covered(shapes(spark, d))


@query("rs10_country_cells", sql=f"""with {LAND},
c as ({fx.plain(fx.CELLS)}), p as (select row_i + 1730 + (select 0) row_i, col_i + 5330 col_i, source, raw from c)
select p.row_i, p.col_i, source, raw from p left join m on m.row_i = p.row_i and m.col_i = p.col_i where raw <> -96 or m.row_i is not null""")
def _(spark, d):
    """The noise grid laid over the shapes, its cells without data outside of them left out."""
    cells = fx.derived(spark, d, fx.CELLS).withColumns({"row_i": F.col("row_i") + 1730, "col_i": F.col("col_i") + 5330})
    return op.of_country(cells, op.covered(shapes(spark, d)), F.col("raw") == -96).select("row_i", "col_i", "source", "raw")
