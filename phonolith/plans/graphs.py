"""Queries over connected cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.operators import graphs as op
from phonolith.plans.registry import query
from phonolith.sources.fixtures import CELLS
from phonolith.sources.scratch import written

#: Labels by walking from each quiet cell to every cell it reaches; UNION keeps a pair once, so the walk ends.
REACH = """with recursive q as (select source, row_i, col_i, row_i * 120 + col_i cell from {t} x where %s),
e as (select a.source, a.cell a, b.cell b from q a join q b on a.source = b.source and (%s)),
w(source, cell, reach) as (select source, cell, cell from q union select w.source, w.cell, e.b from w join e on e.source = w.source and e.a = w.reach),
l as (select source, cell, min(reach) component from w group by 1, 2)"""
FOUR = "abs(a.row_i - b.row_i) + abs(a.col_i - b.col_i) = 1"
EIGHT = "greatest(abs(a.row_i - b.row_i), abs(a.col_i - b.col_i)) = 1"


def quiet(cells):
    return cells.where("raw > 0 and raw < 52").select(F.col("source").alias("group"), "row_i", "col_i")


@query("rs1_components", CELLS, REACH % ("raw > 0 and raw < 52", FOUR) + """
select source "group", cell // 120 row_i, cell % 120 col_i, component from l""")
def _(cells):
    return op.components(quiet(cells), 120)


@query("ag15_wn8_component_summary", CELLS, REACH % ("raw > 0 and raw < 52", FOUR) + """,
s as (select source, component, count(*) cells, min(cell // 120) top, max(cell // 120) bottom, min(cell % 120) "left", max(cell % 120) "right", min(raw) min_db, max(raw) max_db, count(distinct (cell // 120 // 10) * 12 + cell % 120 // 10) tiles
  from l join {t} x using (source) where x.row_i = cell // 120 and x.col_i = cell % 120 group by 1, 2 having count(*) >= 4)
select source "group", component, cells, min_db, max_db, tiles, top, bottom, "left", "right", row_number() over (partition by source order by cells desc, top, "left", component)::int rank,
  left(sha256(source || ':' || component || ':' || cells), 16) component_id from s""")
def _(cells):
    levels = cells.select(F.col("source").alias("group"), "row_i", "col_i", "raw")
    return op.summary(op.components(quiet(cells), 120).join(levels, ["group", "row_i", "col_i"]), 4)


@query("rs3_outline_lengths", CELLS, REACH % ("raw > 0 and raw < 52", FOUR) + """
select l.source "group", l.component, sum(4 - (select count(*) from l m where m.source = l.source and m.component = l.component and abs(m.cell // 120 - l.cell // 120) + abs(m.cell % 120 - l.cell % 120) = 1))::bigint sides,
  count(*)::double area from l group by 1, 2""")
def _(cells):
    rings = op.ring_sums(op.ring_points(op.components(quiet(cells), 120)))
    sign = F.when(F.col("hole"), -1.0).otherwise(1.0)
    return rings.groupBy("group", "component").agg(F.sum("sides").alias("sides"), F.sum(sign * F.col("area")).alias("area"))


@query("rs3_outline_polygons", CELLS)
def _(cells):
    """Components of four cells and more as GeoJSON, in metres from the grid's corner."""
    labelled = op.components(quiet(cells), 120)
    large = labelled.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").drop("n")
    return op.geojson(op.ring_points(labelled.join(large, ["group", "component"])))


@query("rs4_enclosed_unknown", CELLS)
def _(cells):
    """Every source; the aircraft's unknown cells join up over most of the grid, which is too slow as SQL."""
    return op.enclosed(cells, 120, cells.agg(F.max("row_i")).first()[0] + 1)


@query("rs4_enclosed_roads", CELLS, REACH % ("raw = -96 and source <> 'aircraft'", EIGHT) + """,
g as (select source, component, count(*) cells from l group by 1, 2 having min(cell // 120) > 0 and min(cell % 120) > 0 and max(cell // 120) < (select max(row_i) from {t} x) and max(cell % 120) < 119),
n as (select distinct g.source, g.component, g.cells, cell // 120 + r.range row_i, cell % 120 + c.range col_i from g join l using (source, component), range(-1, 2) r, range(-1, 2) c where r.range <> 0 or c.range <> 0),
k as (select n.source "group", n.component, n.cells, case when n.cells <= 4 then '1-4' when n.cells <= 25 then '5-25' when n.cells <= 100 then '26-100' when n.cells <= 1000 then '101-1000' else 'over-1000' end size,
  case when max(x.raw) <= 45 then 'lowest_5db_band' else 'higher_reported_ring' end ring from n left join {t} x on x.source = n.source and x.row_i = n.row_i and x.col_i = n.col_i and x.raw > 0 group by 1, 2, 3)
select "group", size, ring, count(*) components, sum(cells)::bigint cells from k group by 1, 2, 3""")
def _(cells):
    """Classes of enclosed unknown components, of the two sources whose reporting cutoff is 40 dB."""
    height = cells.agg(F.max("row_i")).first()[0] + 1
    return op.inventory(op.enclosed(cells.where("source <> 'aircraft'"), 120, height))


SIZES = (1, 3)


@query("rs5_disjoint_squares", CELLS)
def _(cells):
    height = cells.agg(F.max("row_i")).first()[0] + 1
    found = [op.disjoint_squares(op.candidate_squares(cells, n), n, 120, height).withColumn("size", F.lit(n)) for n in SIZES]
    return found[0].unionByName(found[1])


@query("rs5_rs6_ag33_patch_summary", CELLS)
def _(cells):
    height, parts = cells.agg(F.max("row_i")).first()[0] + 1, []
    for n in SIZES:
        squares = written(op.disjoint_squares(op.candidate_squares(cells, n), n, 120, height))
        strata = squares.select("source", F.concat_ws(":", F.lit(n), "row_i", "col_i").alias("patch"), F.lit(n).alias("size"), "stratum")
        parts.append(op.patch_summary(op.interpolated(cells, op.hidden_cells(squares, cells, n), n), strata))
    return parts[0].unionByName(parts[1])


@query("rs5_rs6_ag33_patch_errors", CELLS)
def _(cells):
    held = op.patches(cells, 2, 6)
    return op.patch_errors(op.interpolated(cells, held, 2))


@query("rs5_ag33_patch_estimates", CELLS, """
with b as (select *, row_i // 6 br, col_i // 6 bc from {t} x),
o as (select *, 1 + ('0x' || substr(md5('row:' || br || ':' || bc), 1, 8))::bigint % 3 off_r, 1 + ('0x' || substr(md5('col:' || br || ':' || bc), 1, 8))::bigint % 3 off_c from b),
h as (select source, br, bc, row_i, col_i, raw, count(*) filter (raw > 0) over (partition by source, br, bc) known from o where row_i - br * 6 - off_r between 0 and 1 and col_i - bc * 6 - off_c between 0 and 1),
w as (select * from h where known = 4),
g as (select distinct w.source, w.br, w.bc, x.row_i kr, x.col_i kc, x.raw v from w join {t} x on x.source = w.source and abs(x.row_i - w.row_i) <= 1 and abs(x.col_i - w.col_i) <= 1 where x.raw > 0 and not exists (select 1 from w y where y.source = w.source and y.br = w.br and y.bc = w.bc and y.row_i = x.row_i and y.col_i = x.col_i)),
r as (select w.source, w.row_i, w.col_i, w.raw, v, pow(w.row_i - kr, 2) + pow(w.col_i - kc, 2) d2, row_number() over (partition by w.source, w.row_i, w.col_i order by pow(w.row_i - kr, 2) + pow(w.col_i - kc, 2), kr, kc) n from w join g using (source, br, bc)),
e as (select source, row_i, col_i, raw, max(v) filter (n = 1) nearest, sum(v / d2) filter (n <= 8) / sum(1 / d2) filter (n <= 8) idw from r group by 1, 2, 3, 4),
m as (select source, 'nearest' "method", nearest - raw d from e union all select source, 'idw', idw - raw from e)
select source, "method", count(*) n, round(sqrt(avg(d * d)), 6) rmse, round(avg(d), 6) bias, round(quantile_cont(abs(d), 0.9), 6) p90 from m group by 1, 2""")
def _(cells):
    held = op.patches(cells, 2, 6)
    out = op.patch_errors(op.interpolated(cells, held, 2)).where("method <> 'harmonic'")
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "bias", "p90")})
