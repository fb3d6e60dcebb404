"""The whole count policy where tables are large: how its counts are derived, and that places and roundings say the same."""

import re

import pytest
from pyspark.sql import functions as F

from phonolith.operators import linkage as op
from phonolith.plans import QUERIES
from phonolith.plans import linkage as plan
from phonolith.sources import fixtures as fx
from test_linkage import LINE, POINT, line, point

SF = "/root/testdata/sf0.001"


class Caught(Exception):
    pass


def test_counts_do_not_try_every_edge(spark, monkeypatch):
    """Counts meet their edge by equality of its number, and are the rows that the text states."""

    def caught(points, *args, **others):
        raise Caught(points)

    monkeypatch.setattr(plan.op, "link_counts", caught)
    with pytest.raises(Caught) as found:
        QUERIES["jn8_linkage_policy"](spark, SF)
    points = found.value.args[0]
    said = points._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(NestedLoopJoin|CartesianProduct)[^\n]*nth", said)
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, fx.derived(spark, SF, plan.COUNTED).collect()))


def test_edges_are_numbered_alike_in_any_blocks(spark, monkeypatch):
    if not hasattr(plan, "LINKS_A_BLOCK"):
        pytest.fail("edges are numbered in one task")
    monkeypatch.setattr(plan, "LINKS_A_BLOCK", 3)
    assert sorted(map(tuple, plan.counted(spark, SF).collect())) == sorted(map(tuple, fx.derived(spark, SF, plan.COUNTED).collect()))


def test_fine_is_round(spark):
    values = [0.0, -0.0, 25.0, 24.9999995, 25.0000005, 0.0000005, 1.0000015, -1.0000015, 2.5e-7, 1e5 + 0.0000005, 1e6, 1e12 + 0.5, -1e300, float("nan"), float("inf"), None]
    values += [k / 7 for k in range(-300, 300)] + [(k + 0.5) / 1e6 for k in range(0, 3000, 7)] + [(k + 0.5) / 1e6 + 1e-12 for k in range(0, 3000, 11)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(op.fine(F.col("v")).alias("a"), F.round("v", 6).alias("b"))
    assert rows.where("not a <=> b").count() == 0


def test_counts_in_one_place(spark):
    """Counts in the same place have one place's links, each with its own traffic; an unsound one among them stays refused."""
    lines = [line(1, (0, 0), (100, 0)), line(2, (0, 12), (100, 12)), line(3, (0, 500), (100, 500))]
    points = [point(1), point(2), point(3, flow=-1.0), point(4, y=500.0), point(5, x=None), point(6, y=500.0, road_name="B4044")]
    got = {r.point_id: r for r in op.link_counts(spark.createDataFrame(points, POINT), spark.createDataFrame(lines, LINE)).collect()}
    assert {i: (r.reason, r.proposed_link_id, r.candidates) for i, r in got.items()} == {
        1: (op.RIVAL, 1, 2), 2: (op.RIVAL, 1, 2), 3: (op.BAD_TRAFFIC, None, None), 4: (op.ACCEPTED, 3, 1), 5: (op.BAD_TRAFFIC, None, None), 6: (op.BAD_ROAD, None, None),
    }
    assert got[1].margin == 12.0 and got[4].margin is None
