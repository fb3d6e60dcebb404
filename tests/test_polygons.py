"""Polygons with holes and islands against ray casting in plain Python."""

import random

from pyspark.sql import functions as F

from phonolith.operators import polygons as op

SCHEMA = "polygon_id long, rings array<array<struct<x:double,y:double>>>"


def odd(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_points_in_many_polygons(spark):
    rng = random.Random(2)
    shapes = [(i, [[(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))]) for i in range(20)]
    points = [(i, rng.uniform(-20, 320), rng.uniform(-20, 320)) for i in range(400)]
    want = {(p, i) for p, x, y in points for i, rings in shapes if odd(x, y, rings)}
    table = spark.createDataFrame(points, "p long, x double, y double")
    for band in (7.0, 1000.0):
        assert {tuple(r) for r in op.inside(table, spark.createDataFrame(shapes, SCHEMA), "p", band).collect()} == want
    dense = op.densified(spark.createDataFrame(shapes, SCHEMA), 3.0)
    assert {tuple(r) for r in op.inside(table, dense, "p").collect()} == want and dense.select(F.size(F.expr("rings[0]"))).first()[0] > 50


def test_holes_islands_and_sides(spark):
    """A closed outer ring, a hole and an island in it; two squares that share a side share no point."""
    shapes = [(1, [square(0.0, 0.0, 9.0) + [(0.0, 0.0)], square(3.0, 3.0, 3.0), square(4.0, 4.0, 1.0)]), (2, [square(9.0, 0.0, 9.0)]), (3, [[(0.0, 0.0), (1.0, 1.0)]]), (4, None), (5, [])]
    points = [(1, 1.0, 1.0), (2, 3.5, 3.5), (3, 4.5, 4.5), (4, 9.0, 4.0), (5, 0.0, 0.0), (6, 18.0, 3.0), (7, 5.0, 9.0), (8, 3.0, 3.0), (9, None, 1.0)]
    got = {tuple(r) for r in op.inside(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(shapes, SCHEMA), "p", 4.0).collect()}
    assert got == {(1, 1), (3, 1), (4, 2), (5, 1)}


def test_coarse_cells_count_fine_middles(spark):
    rng = random.Random(5)
    shapes = [(i, [[(rng.uniform(-200, 300), rng.uniform(-200, 300)) for _ in range(6)], square(-50.0, -50.0, 60.0)]) for i in range(4)]
    inside = {(r, c) for r in range(-12, 17) for c in range(-12, 17) if any(odd(c * 20 + 10, r * 20 + 10, rings) for _, rings in shapes)}
    want = {}
    for r, c in inside:
        want[r // 5, c // 5] = want.get((r // 5, c // 5), 0) + 1
    table = spark.createDataFrame(shapes, SCHEMA)
    assert {(r.row_i, r.col_i): r.middles for r in op.covered(table).collect()} == want
    assert op.covered(table.limit(0)).count() == 0
    cells = spark.createDataFrame([(r, c, v) for r in range(-3, 4) for c in range(-3, 4) for v in (-96.0, 50.0)], "row_i long, col_i long, raw double")
    kept = [(r.row_i, r.col_i, r.raw) for r in op.of_country(cells, op.covered(table), F.col("raw") == -96).collect()]
    assert sorted(kept) == sorted((r, c, v) for r in range(-3, 4) for c in range(-3, 4) for v in (-96.0, 50.0) if v > 0 or (r, c) in want)
