"""Polygons as rows: points in them, and the cells they cover, by the even-odd rule.

polygons: polygon_id, rings (arrays of struct<x, y>; outer rings, holes and islands in them alike, closed or not). Edges go
into bands of y, a point looks into its own band only, and parity is a sum for each point and polygon: neither polygons nor
their number are bounded by what a task or a broadcast holds. A point on a left or lower side counts as inside, on a right
or upper one as outside, so polygons that share a side share no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = "transform(filter(coalesce(rings, array()), r -> size(r) > 2), r -> if(r[0] = r[size(r) - 1], r, concat(r, array(r[0]))))"


def polygons_of(vertices: DataFrame) -> DataFrame:
    """polygon_id and rings from rows (polygon_id, ring, seq, x, y)."""
    rings = vertices.groupBy("polygon_id", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    whole = rings.groupBy("polygon_id").agg(F.sort_array(F.collect_list(F.struct("ring", "p"))).alias("rings"))
    return whole.withColumn("rings", F.transform("rings", lambda r: F.transform(r["p"], lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))


def sides(polygons: DataFrame) -> DataFrame:
    """polygon_id, ax, ay, bx, by of every side that is not level, from its lower to its upper end."""
    pairs = F.expr(f"flatten(transform({CLOSED}, r -> transform(slice(r, 2, size(r) - 1), (p, i) -> if(p.y > r[i].y, struct(r[i].x as ax, r[i].y as ay, p.x as bx, p.y as by), struct(p.x as ax, p.y as ay, r[i].x as bx, r[i].y as by)))))")
    return polygons.select("polygon_id", F.explode(pairs).alias("s")).select("polygon_id", "s.*").where("ay < by")


def densified(polygons: DataFrame, step: float) -> DataFrame:
    """polygons with more points on their sides, none further than step from the next: for outlines that are projected afterwards."""
    n = f"cast(greatest(1, ceil(sqrt((p.x - r[i].x) * (p.x - r[i].x) + (p.y - r[i].y) * (p.y - r[i].y)) / {step})) as int)"
    cut = f"transform({CLOSED}, r -> flatten(transform(slice(r, 2, size(r) - 1), (p, i) -> transform(sequence(0, {n} - 1), k -> struct(r[i].x + (p.x - r[i].x) * k / {n} as x, r[i].y + (p.y - r[i].y) * k / {n} as y)))))"
    return polygons.withColumn("rings", F.expr(cut))


def inside(points: DataFrame, polygons: DataFrame, key: str, band: float = 1000.0) -> DataFrame:
    """(key, polygon_id) for every point (key, x, y; keys are unique) within a polygon; points in no polygon have no row."""
    reach = F.min(F.least("ax", "bx")).alias("west"), F.max(F.greatest("ax", "bx")).alias("east")
    own = sides(polygons)
    boxes = own.groupBy("polygon_id").agg(*reach)
    at = lambda c: F.floor(c / band).cast("long")
    held = own.join(boxes, "polygon_id").withColumn("band", F.explode(F.sequence(at(F.col("ay")), at(F.col("by")))))
    met = points.select(key, "x", "y", at(F.col("y")).alias("band")).join(held, "band").where("ay <= y and y < by and west <= x and x <= east")
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    return met.where(right).groupBy(key, "polygon_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "polygon_id")


def _first_middle(v: Column, cell: float) -> Column:
    """The first cell whose middle is not below v; the middle itself is compared, as the division may round."""
    c = F.ceil(v / cell - 0.5).cast("long")
    return F.when((c - 0.5) * cell >= v, c - 1).when((c + 0.5) * cell < v, c + 1).otherwise(c)


def spans(polygons: DataFrame, cell: float) -> DataFrame:
    """polygon_id, row_i, and from_i to to_i of the columns whose middles lie inside: a row of middles at a time, between its crossings.

    Cells have their lower left corner at (column * cell, row * cell).
    """
    low, high = _first_middle(F.col("ay"), cell), _first_middle(F.col("by"), cell) - 1
    rows = sides(polygons).withColumns({"low": low, "high": high}).where("low <= high").withColumn("row_i", F.explode(F.sequence("low", "high")))
    y = (F.col("row_i") + 0.5) * cell
    x = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    crossed = rows.select("polygon_id", "row_i", x.alias("x")).groupBy("polygon_id", "row_i").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.expr("transform(sequence(0, size(xs) div 2 - 1), i -> struct(xs[2 * i] as x0, xs[2 * i + 1] as x1))")
    cut = crossed.where("size(xs) > 1").select("polygon_id", "row_i", F.explode(pairs).alias("p"))
    first, last = _first_middle(F.col("p.x0"), cell), _first_middle(F.col("p.x1"), cell) - 1
    return cut.select("polygon_id", "row_i", first.alias("from_i"), last.alias("to_i")).where("from_i <= to_i")


def covered(polygons: DataFrame, fine: float = 20.0, factor: int = 5) -> DataFrame:
    """row_i, col_i, middles: coarse cells of which any of factor x factor fine middles lies in a polygon, and how many do.

    A middle that several polygons cover counts once: a coarse cell's middles are bits of a number, so factor is at most 7.
    """
    own = spans(polygons, fine)
    block = F.floor(F.col("from_i") / factor).cast("long"), F.floor(F.col("to_i") / factor).cast("long")
    cut = own.withColumn("col_i", F.explode(F.sequence(*block)))
    a, b = F.greatest("from_i", F.col("col_i") * factor), F.least("to_i", F.col("col_i") * factor + factor - 1)
    cut = cut.withColumns({"n": (b - a + 1).cast("int"), "at": (F.pmod("row_i", F.lit(factor)) * factor + F.pmod(a, F.lit(factor))).cast("int")})
    bits = F.expr("shiftleft(shiftleft(1L, n) - 1L, at)")  # a run of middles in one row of the coarse cell
    each = cut.select(F.floor(F.col("row_i") / factor).cast("long").alias("row_i"), "col_i", bits.alias("bits"))
    return each.groupBy("row_i", "col_i").agg(F.bit_or("bits").alias("bits")).select("row_i", "col_i", F.bit_count("bits").cast("long").alias("middles"))


def of_country(cells: DataFrame, land: DataFrame, nodata: Column) -> DataFrame:
    """cells without those that hold no data and lie outside land(row_i, col_i); every value stays, wherever it is."""
    known = land.select("row_i", "col_i").distinct().withColumn("land", F.lit(True))
    return cells.join(known, ["row_i", "col_i"], "left").where(~nodata | F.coalesce("land", F.lit(False))).drop("land")
