"""Levels, cells and lattices against known values and cell-by-cell recomputation."""

import math

import pytest
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac
from phonolith.functions import geometry as geo
from phonolith.operators import cells as op
from phonolith.operators import graphs


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_decibels_add_as_energy(spark):
    f = F.lit(40.0)
    got = one(spark, two=ac.db_sum(f, f), three=ac.db_sum(f, f, f), block=ac.energy_to_db(ac.db_to_energy(F.lit(50.0)) / 4), none=ac.db_sum(F.lit(None).cast("double")), part=ac.db_sum(f, F.lit(None).cast("double")))
    assert round(got.two, 4) == 43.0103 and round(got.three, 4) == 44.7712 and round(got.block, 4) == 43.9794 and got.none is None and round(got.part, 9) == 40
    assert one(spark, zero=ac.energy_to_db(F.lit(0.0)), minus=ac.energy_to_db(F.lit(-1.0))) == (None, None)


def test_readings_of_codes(spark):
    rows = [("road", 55.5), ("road", 0.0), ("road", -96.0), ("aircraft", 0.0), ("rail", 40.0), ("rail", 39.9), ("rail", 70.0), ("rail", None)]
    got = op.read(spark.createDataFrame(rows, "source string, raw double")).collect()
    assert [r.status for r in got] == ["reported_model_value", "verified_below_cutoff", "unreported_unknown", "unreported_unknown", *["reported_model_value"] * 3, "outside_extract"]
    assert [r["class"] for r in got] == [7, 2, 1, 1, 4, 3, 10, 0] and [r.code for r in got] == [5553, 2, 1, 1, 4003, 3993, 7003, 0]
    with pytest.raises(Exception, match="unrecognised noise code"):
        op.read(spark.createDataFrame([("road", 200.0)], "source string, raw double")).collect()


def test_difference_keeps_strictness(spark):
    e = lambda x: ac.interpret(F.lit(x), F.lit(40.0))
    got = one(spark, a=ac.difference_bounds(e(50.0), e(0.0)), b=ac.difference_bounds(e(0.0), e(50.0)), c=ac.difference_bounds(e(0.0), e(0.0)), d=ac.difference_bounds(e(50.0), e(45.0)))
    assert got.a[:] == (None, -10.0, False, False) and got.b[:] == (10.0, None, False, False) and got.c is None and got.d[:] == (-5.0, -5.0, True, True)


def test_classes_of_averages(spark):
    rows = [(10**6 + 10**4, 2, 0), (10**4.1, 4, 0), (0.0, 0, 3), (0.0, 0, 0), (10**5.25, 1, 0)]
    df = spark.createDataFrame([(float(a), b, c) for a, b, c in rows], "e double, land int, nodata int")
    got = [r[0] for r in df.select(ac.display_class_of_average(F.col("e"), F.col("land"), F.col("nodata"), F.lit(40.0))).collect()]
    assert got == [ac.CLASS_FIRST + 4, ac.CLASS_BELOW, ac.CLASS_NODATA, ac.CLASS_OUTSIDE, ac.CLASS_FIRST + 3]


def test_edges_of_squares_are_west_and_north(spark):
    i, j = geo.owner(F.lit(15005.0), F.lit(15005.0))
    a, b = geo.owner(F.lit(15004.9), F.lit(15005.1))
    assert one(spark, i=i, j=j, a=a, b=b) == (1, 0, 0, 1)


def test_hexagons_hold_their_points(spark):
    points = spark.range(500).select((F.rand(1) * 40000).alias("x"), (F.rand(2) * 40000).alias("y"))
    q, r = geo.hex_key(F.col("x"), F.col("y"))
    own = points.select("x", "y", q.alias("q"), r.alias("r"))
    for p in own.collect():
        centre = lambda a, b: (3000 * math.sqrt(3) * (a + b / 2), 4500 * b)
        best = min(math.dist((p.x, p.y), centre(p.q + i, p.r + k)) for i in (-1, 0, 1) for k in (-1, 0, 1))
        assert math.isclose(best, math.dist((p.x, p.y), centre(p.q, p.r)), abs_tol=1e-6)
    corners = own.limit(1).select(geo.hex_corners(F.col("q"), F.col("r")).alias("c")).first().c
    assert len(corners) == 6 and all(math.isclose(math.dist((c.x, c.y), (corners[i - 1].x, corners[i - 1].y)), 3000) for i, c in enumerate(corners))


def test_national_grid_of_a_known_point(spark):
    e, n = geo.grid_from_wgs84(F.lit(1.716073973), F.lit(52.658007833))
    got = one(spark, e=e, n=n)
    assert math.dist((got.e, got.n), (651409.804, 313177.450)) < 6


def test_line_integral_adds_up_when_split(spark):
    at = lambda *s: geo.line_integral(F.lit(3.0), F.lit(40.0), *[F.lit(float(v)) for v in s])
    got = one(spark, whole=at(0, 0, 100, 20), a=at(0, 0, 50, 10), b=at(50, 10, 100, 20))
    assert abs(got.whole - got.a - got.b) < 1e-10


def blob(spark, cells):
    return spark.createDataFrame([("g", r, c) for r, c in cells], "group string, row_i long, col_i long")


def test_components_cross_tiles_and_ignore_order(spark):
    wall = [(5, c) for c in range(200)] + [(r, 199) for r in range(6, 150)] + [(149, c) for c in range(60, 199)] + [(100, 10), (101, 11)]
    for cells in (wall, wall[::-1]):
        got = graphs.components(blob(spark, cells), 1000).groupBy("component").count().collect()
        assert sorted(r["count"] for r in got) == [1, 1, len(wall) - 2]
    assert sorted(r["count"] for r in graphs.components(blob(spark, wall), 1000, eight=True).groupBy("component").count().collect()) == [2, len(wall) - 2]


def test_outline_of_a_ring_has_a_hole(spark):
    ring = [(r, c) for r in range(4) for c in range(4) if not (1 <= r <= 2 and 1 <= c <= 2)]
    got = graphs.outlines(graphs.components(blob(spark, ring), 100)).collect()
    assert sorted((r.hole, r.area, len(r.points)) for r in got) == [(False, 16.0, 16), (True, 4.0, 8)]


def test_plane_is_interpolated_exactly(spark):
    cells = spark.createDataFrame([("road", r, c, 40.0 + r + 2 * c) for r in range(12) for c in range(12)], "source string, row_i long, col_i long, raw double")
    held = graphs.patches(cells, 2, 6)
    got = graphs.interpolated(cells, held, 2).collect()
    assert len(got) == held.count() == 16 and all(abs(r.harmonic - r.raw) < 1e-9 for r in got)
