"""Queries over roads as lines that bend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.operators import polylines as op
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

RADII = (250, 500, 1000, 2000, 5000, 10000)
EDGES = """v as (select link_id, part, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2, row_number() over w - 1 edge, {others} from {t} q window w as (partition by link_id, part order by seq)),
e as (select *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) length from v where x2 is not null),
k as (select *, sum(length) over (partition by link_id order by part, seq rows unbounded preceding) - length chainage from e where length > 0)"""
PLAIN = EDGES.replace("{others}", "flow")


def lines(vertices: DataFrame) -> DataFrame:
    return op.lines_of(vertices, "flow", "hgv_flow", "road_class")


@query("prj14_longest_edge", fx.VERTICES, "with " + PLAIN + """
select link_id, round(coalesce(first(((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180 order by length desc, part, seq), 0), 6) angle, round(sum(length), 4) length, count(*) edges from k group by 1
union all select link_id, 0, 0, 0 from {t} q group by 1 having link_id not in (select link_id from k)""")
def _(x):
    return op.orientations(lines(x)).withColumns({"angle": F.round("angle", 6), "length": F.round("length", 4)})


@query("prj15_line_cells", fx.VERTICES, "with " + PLAIN + """,
n as (select *, ceil(length / 25)::int n from k), c as (select *, unnest(range(0, n))::int cell from n)
select link_id, part, edge::int edge, cell, round(chainage + cell * length / n, 4) from_m, round(chainage + (cell + 1) * length / n, 4) to_m, round(x1 + (x2 - x1) * cell / n, 4) px1, round(y1 + (y2 - y1) * cell / n, 4) py1,
  round(x1 + (x2 - x1) * (cell + 1) / n, 4) px2, round(y1 + (y2 - y1) * (cell + 1) / n, 4) py2 from c""")
def _(x):
    return op.cells(lines(x)).withColumns({c: F.round(c, 4) for c in ("from_m", "to_m", "px1", "py1", "px2", "py2")})


T = "least(1.0, greatest(0.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/(length*length)))"
AT, OFF = "(((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/length)", "(((x-x1)*(y2-y1)-(y-y1)*(x2-x1))/length)"
SUMS = ", ".join(
    f"""count(*) filter (dist <= {r}) links_{r}, round(coalesce(sum(square) filter (dist <= {r}), 0), 6) square_{r}, round(coalesce(sum(heavy) filter (dist <= {r}), 0), 6) heavy_{r},
  round(coalesce(sum(energy) filter (dist <= {r}), 0), 2) energy_{r}, round(coalesce(sum(energy) filter (dist <= {r} and not direct), 0) / greatest(coalesce(sum(energy) filter (dist <= {r}), 0), 1e-12), 6) imputed_{r}"""
    for r in RADII
)


@query("jn4_line_exposure", sql="with " + EDGES.replace("{others}", "flow, hgv_flow").replace("{t}", f"({fx.plain(fx.VERTICES)})") + f""",
p as (select receptor_id, link_id, min(sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2))) dist, max(flow) flow, max(hgv_flow) hgv_flow, link_id % 3 <> 0 direct,
    max(flow) * greatest(0.0, sum(asinh((length - {AT}) / sqrt(pow({OFF}, 2) + 100)) - asinh(-{AT} / sqrt(pow({OFF}, 2) + 100)))) energy
  from (select *, {T} t from ({fx.plain(fx.RECEPTORS)}) r, k) q group by 1, 2),
o as (select *, flow / pow(greatest(dist, 10.0), 2) square, hgv_flow / pow(greatest(dist, 10.0), 2) heavy from p where dist <= {max(RADII)})
select receptor_id, round(min(dist), 4) nearest, first(flow order by dist, link_id) nearest_flow, {SUMS} from o group by 1""")
def _(spark, d):
    """Every receptor, 250 m to 10 km in one pass; the flow of two lines in three was counted."""
    roads = lines(fx.derived(spark, d, fx.VERTICES)).withColumns({"emission": F.col("flow"), "direct": F.col("link_id") % 3 != 0})
    out = op.exposure(fx.derived(spark, d, fx.RECEPTORS), roads, RADII)
    digits = {"nearest": 4} | {f"{c}_{r}": n for r in RADII for c, n in (("square", 6), ("heavy", 6), ("energy", 2), ("imputed", 6))}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
