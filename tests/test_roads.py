"""Edge cases of road, place and projection operators that the derived tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import cells, places, roads, spatial


def test_projection_there_and_back(spark):
    """A published point (52 39 27.2531 N, 1 43 4.5177 E on Airy) and a round trip over the whole grid."""
    points = spark.createDataFrame([(i, 100_000.0 + 61_000.0 * i, 20_000.0 + 110_000.0 * i) for i in range(9)], "id int, x double, y double")
    back = geo.with_grid(geo.wgs84_from_grid(points, "x", "y"), "lon", "lat")
    assert all(abs(r.easting - r.x) < 1e-3 and abs(r.northing - r.y) < 1e-3 for r in back.collect())
    one = geo.with_grid(spark.createDataFrame([(1.716073973, 52.658007833)], "lon double, lat double"), "lon", "lat").first()
    assert math.dist((one.easting, one.northing), (651409.9, 313177.3)) < 10


def test_search_ranks_as_people_type(spark):
    rows = [
        (1, "High Street", "Oxford, OX1", 3, 0.0, 0.0), (2, "High Street", "Witney, OX28", 3, 9000.0, 0.0), (3, "Oxford", "Oxfordshire", 1, 100.0, 0.0), (4, "Oxford Road", "Abingdon", 3, 0.0, 500.0), (5, "St John's Road", "Oxford", 3, 0.0, 0.0),
        (6, "Old High Lane", "Oxford", 3, 0.0, 0.0), (7, "Street End", "Kent", 2, 0.0, 0.0),
    ]
    table = spark.createDataFrame(rows, "id long, name string, detail string, tier long, x double, y double")
    typed = {1: "12 high st", 2: "oxf", 3: "oxford rd", 4: "saint johns", 5: "high street oxford", 6: "17", 7: "  ", 8: "st end"}
    queries = spark.createDataFrame([(q, w, 0.0, 0.0) for q, w in typed.items()], "query_id long, words string, near_x double, near_y double")
    found = {}
    for r in sorted(places.search(queries, table).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.id)
    assert found[1] == [1, 2] and found[2] == [3, 4] and found[3] == [4, 5] and found[4] == [5] and found[5] == [1] and 6 not in found and 7 not in found and found[8] == [7]


def test_names_are_refilled_where_nothing_else_is_left(spark):
    rows = [(1, i, i, n, i) for i, n in enumerate(["A", "B", "B", "B", "B", "C", "B", "A"], 1)]
    found = spark.createDataFrame(rows, "query_id long, rank int, id long, name string, cost int")
    ids = lambda k: [r.id for r in sorted(places.first_of_name(found, k=k).collect(), key=lambda r: r.rank)]
    assert ids(6) == [1, 2, 3, 4, 6, 8] and ids(8) == [1, 2, 3, 4, 6, 8, 5, 7]


def test_short_keys_find_their_codes(spark):
    q = spark.createDataFrame([(1, "OX1"), (2, "OX"), (3, "E"), (4, "OX12"), (5, "")], "query_id long, key string")
    p = spark.createDataFrame([("OX11AA",), ("OX1A",), ("OX2",), ("OX12BB",), ("E1",)], "code string")
    got = sorted(tuple(r) for r in places.by_prefix(q, p).collect())
    assert got == [(1, "OX1A"), (2, "OX11AA"), (2, "OX12BB"), (2, "OX1A"), (2, "OX2"), (3, "E1"), (4, "OX12BB")]


def test_long_links_run_side_by_side(spark):
    """Two links of 5 km that overlap by a little over half have their middles over 2 km apart."""
    links = spark.createDataFrame([(1, 0.0, 0.0, 5000.0, 0.0), (2, 2400.0, 20.0, 7400.0, 20.0), (3, 2600.0, 20.0, 7600.0, 20.0)], "link_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.link_id, r.o_link_id) for r in spatial.parallel(links, reach=60.0).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 2)}
    near = {(r.link_id, r.o_link_id): round(r.overlap) for r in spatial.parallel(links, reach=3000.0).collect()}
    assert near[1, 2] == 2600 and near[2, 1] == 2600 and (1, 3) not in near and near[2, 3] == 4800


def test_tiles_own_their_west_and_north_edges(spark):
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, 15.0, 0.0, 25.0, 10.0)], "tile_id long, minx double, miny double, maxx double, maxy double")
    points = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 10.0), (3, 5.0, 0.0), (4, 16.0, 5.0), (5, 25.0, 5.0)], "point_id long, x double, y double")
    got = {r.point_id: (r.tile_id, r.state) for r in roads.tile_of(points, tiles, 10.0).collect()}
    assert got == {1: (1, "owned"), 2: (2, "owned"), 3: (None, "no_tile"), 4: (None, "ambiguous"), 5: (None, "no_tile")}


def test_unsound_bands_are_refused(spark):
    good = (True, 50.0, 55.0, -9999.0, 0.0, 60.0)
    schema = "land boolean, combined_lower double, road_rail_upper double, airport_lower double, airport_fraction double, combined_upper double"
    checks = lambda *rows: cells.require_sound(cells.band_checks(spark.createDataFrame(list(rows), schema).withColumn("tile", F.lit(1)), [F.col("tile")], (40.0, 40.0)))
    assert checks(good).first().sound
    with pytest.raises(Exception, match="not sound"):
        checks(good, (True, 70.0, 55.0, -9999.0, 0.0, 60.0)).collect()


def test_least_squares_on_two_features(spark):
    from phonolith.operators import models

    rows = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 + 3.0 * i - 0.5 * (i * i % 7)) for i in range(30)] + [(None, 1.0, 5.0)], "a double, b double, y double")
    assert max(abs(x - y) for x, y in zip(models.least_squares(rows, ["a", "b"], "y"), (2.0, 3.0, -0.5), strict=True)) < 1e-9
