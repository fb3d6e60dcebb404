"""Counts on links: each rule alone, in its order, and at its limits; tags and heights; search through the county."""

import pytest

from phonolith.operators import linkage as op
from phonolith.operators import places, scenes

POINT = "point_id long, x double, y double, year int, flow double, hgv_flow double, road_type string, road_name string, method string"
LINE = "link_id long, parts array<array<struct<x:double,y:double>>>, road_class string, form_of_way string, structure string, fictitious boolean"


def point(i, x=50.0, y=0.0, **other):
    own = {"year": 2021, "flow": 300.0, "hgv_flow": 10.0, "road_type": "Minor", "road_name": "C", "method": "Counted"} | other
    return (i, x, y, *own.values())


def line(i, *points, **other):
    own = {"road_class": "minor", "form_of_way": "Single Carriageway", "structure": "", "fictitious": False} | other
    return (i, [[(float(x), float(y)) for x, y in points]], *own.values())


def decide(spark, points, lines, **other):
    rows = op.link_counts(spark.createDataFrame(points, POINT), spark.createDataFrame(lines, LINE), **other).collect()
    return {r.point_id: r for r in rows}


STRAIGHT = ((0, 0), (100, 0))


def test_reasons_of_points(spark):
    points = [
        point(1), point(2, year=2020), point(3, flow=0.0), point(4, hgv_flow=301.0), point(5, flow=float("nan")), point(6, road_type="Major", method="Modelled"), point(7, road_name=" u "), point(8, road_name=None), point(9, method="Modelled"),
        point(10, y=10.0), point(11, y=10.001), point(12, x=20.0), point(13, x=19.99), point(14, x=50.0, y=900.0), point(15, x=None),
    ]
    apart = [(p[0], p[1], p[2] + 2000.0 * p[0], *p[3:]) for p in points]  # each has a link of its own
    got = decide(spark, apart, [line(p[0], (0, 2000 * p[0]), (100, 2000 * p[0])) for p in points])
    want = {1: op.ACCEPTED, 2: op.BAD_TRAFFIC, 3: op.BAD_TRAFFIC, 4: op.BAD_TRAFFIC, 5: op.BAD_TRAFFIC, 6: op.BAD_ROAD, 7: op.ACCEPTED, 8: op.BAD_ROAD, 9: op.BAD_METHOD, 10: op.ACCEPTED, 11: op.NO_ROAD, 12: op.ACCEPTED, 13: op.NEAR_END, 14: op.NO_ROAD, 15: op.BAD_TRAFFIC}
    assert {i: r.reason for i, r in got.items()} == want
    assert got[12].clearance == 20.0 and got[11].proposed_link_id is None and got[2].candidates is None and got[14].candidates == 0


def test_reasons_of_links_in_their_order(spark):
    """Form comes before occupation, occupation before clearance, clearance before rivals; fictitious links are no rivals."""
    rival = line(2, (0, 12), (100, 12), road_class="motorway")
    cases = [
        ({"road_class": "a_road", "form_of_way": "Slip Road"}, op.BAD_CLASS, 50.0), ({"form_of_way": "Slip Road"}, op.BAD_FORM, 5.0), ({"structure": "Bridge"}, op.BAD_FORM, 50.0), ({"structure": None}, op.BAD_FORM, 50.0), ({}, op.NEAR_END, 5.0), ({}, op.RIVAL, 50.0),
    ]
    for other, reason, x in cases:
        assert decide(spark, [point(1, x=x)], [line(1, *STRAIGHT, **other), rival])[1].reason == reason
    taken = spark.createDataFrame([(1,)], "link_id long")
    assert decide(spark, [point(1, x=5.0)], [line(1, *STRAIGHT), rival], occupied=taken)[1].reason == op.OCCUPIED
    assert decide(spark, [point(1)], [line(1, *STRAIGHT), line(2, (0, 15), (100, 15))])[1].margin == 15.0
    ghost = decide(spark, [point(1)], [line(1, *STRAIGHT), line(2, (0, 3), (100, 3), fictitious=True)])[1]
    assert (ghost.reason, ghost.candidates, ghost.margin) == (op.ACCEPTED, 1, None)
    shared = decide(spark, [point(1), point(2, x=60.0)], [line(1, *STRAIGHT)])
    assert {r.reason for r in shared.values()} == {op.SHARED} and not any(r.accepted_link_id for r in shared.values())
    edge = decide(spark, [point(1, x=50.0)], [line(1, *STRAIGHT)], bounds=(25.0, -100.0, 200.0, 100.0))
    assert edge[1].reason == op.ACCEPTED and decide(spark, [point(1, x=49.0)], [line(1, *STRAIGHT)], bounds=(25.0, -100.0, 200.0, 100.0))[1].reason == op.BAD_MARGIN


def test_rings_and_lines_that_cross_themselves(spark):
    rows = [line(1, (0, 0), (9, 0), (9, 9), (0, 0)), line(2, (0, 0), (9, 0), (9, 9), (5, -5)), line(3, (0, 0), (9, 0), (4, 0)), line(4, (0, 0), (9, 0), (9, 9), (0, 9)), line(5, (0, 0), (9, 0)), line(6, (0, 0), (9, 0), (9, 0), (9, 5), (20, 5), (20, -5), (15, -5))]
    got = {r.link_id: r.bent for r in op.closed_or_crossing(spark.createDataFrame(rows, LINE)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_bad_input_is_refused(spark):
    with pytest.raises(ValueError, match="identity"):
        decide(spark, [point(1), point(1)], [line(1, *STRAIGHT)])
    with pytest.raises(ValueError, match="network"):
        decide(spark, [point(1)], [line(1, *STRAIGHT)], occupied=spark.createDataFrame([(7,)], "link_id long"))
    with pytest.raises(ValueError, match="bounds"):
        decide(spark, [point(1)], [line(1, *STRAIGHT)], bounds=(1.0, 0.0, 1.0, 5.0))


def test_barrier_tags(spark):
    rows = [(1, {"barrier": "wall", "man_made": "embankment"}), (2, {"wall": "noise_barrier", "barrier": "fence", "height": "3 metres"}), (3, {"man_made": "dyke", "height": "2.5m"}), (4, {"man_made": "embankment", "height": "5."}), (5, {}), (6, {"barrier": "hedge", "height": "9" * 400}), (7, None)]
    got = {r.feature_id: tuple(r[1:]) for r in scenes.barriers(spark.createDataFrame(rows, "feature_id long, tags map<string,string>")).collect()}
    assert got == {
        1: ("generic_wall_candidate", None, "missing"), 2: ("explicit_noise_barrier_candidate", None, "ambiguous_or_unhandled_units"), 3: (scenes.NO_BARRIER, 2.5, "explicit_metres_unverified"),
        4: ("embankment_candidate", None, "ambiguous_or_unhandled_units"), 5: (scenes.NO_BARRIER, None, "missing"), 6: (scenes.NO_BARRIER, None, "nonpositive_or_nonfinite"), 7: (scenes.NO_BARRIER, None, "missing"),
    }


def test_search_through_the_county(spark):
    rows = [(1, "Oxford", "Oxfordshire", "Oxfordshire", 1, 0.0, 0.0), (2, "High Street", "Oxford", "Oxfordshire", 3, 0.0, 0.0), (3, "High Street", "Witney", "Oxfordshire", 3, 0.0, 0.0), (4, "Rose & Crown Lane", "Hook", "Hampshire", 3, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "id long, name string, detail string, county string, tier long, x double, y double")
    typed = {1: "high street oxfordshire", 2: "flat 3 12b high st", 3: "rose and crown", 4: "unit", 5: "rose & cr"}
    queries = spark.createDataFrame([(q, w, 0.0, 0.0) for q, w in typed.items()], "query_id long, words string, near_x double, near_y double")
    found = {}
    for r in sorted(places.search(queries, table).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.id, r.cost))
    assert found == {1: [(2, 6), (3, 6)], 2: [(2, 3), (3, 3)], 3: [(4, 3)], 5: [(4, 3)]}


def test_a_limit_met_exactly_is_kept_whatever_the_last_bit(spark):
    """A count 3 m beside a line and 20 m from its end: in floating point the 20 m come out a bit short."""
    import math

    from phonolith.operators import linkage, polylines

    found, n = [], 0
    rows, points = [], []
    for dx in range(1, 120, 7):  # lines of many directions, each far from the others
        length, y = math.hypot(dx, 57), 1000.0 * n
        ux, uy = dx / length, 57 / length
        rows += [(n, 0, k, 531000.0 + k * 3 * dx, 171000.0 + y + k * 3 * 57, "minor", "Single Carriageway", "", False) for k in range(2)]
        points.append((n, 531000.0 + 20 * ux - 3 * uy, 171000.0 + y + 20 * uy + 3 * ux, 2021, 100.0, 1.0, "Minor", "C", "Counted"))
        n += 1
    lines = polylines.lines_of(spark.createDataFrame(rows, "link_id long, part int, seq int, x double, y double, road_class string, form_of_way string, structure string, fictitious boolean"), "road_class", "form_of_way", "structure", "fictitious")
    counts = spark.createDataFrame(points, "point_id long, x double, y double, year int, flow double, hgv_flow double, road_type string, road_name string, method string")
    found = {r.reason for r in linkage.link_counts(counts, lines).collect()}
    assert found == {"unique_local_geometric_support"}
