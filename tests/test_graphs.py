"""Connected cells, outlines and hold-out squares against searches in plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.operators import graphs as op
from phonolith.sources import scratch


def flood(cells, eight=False):
    """{cell: least cell of its component} of a set of (row, col)."""
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (eight or not (r and c))]
    root = {}
    for start in sorted(cells):
        if start in root:
            continue
        todo = [start]
        root[start] = start
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                n = (r + dr, c + dc)
                if n in cells and n not in root:
                    root[n] = start
                    todo.append(n)
    return root


def grid(spark, cells, group="a"):
    return spark.createDataFrame([(group, r, c) for r, c in sorted(cells)], "group string, row_i long, col_i long")


def snake(n, width):
    """A path of one cell's width that winds over the whole grid."""
    cells = set()
    for k in range(n):
        cells |= {(2 * k, c) for c in range(width)}
        if k < n - 1:
            cells.add((2 * k + 1, 0 if k % 2 else width - 1))
    return cells


@pytest.mark.parametrize("eight", [False, True])
def test_components_match_flood_fill(spark, eight, monkeypatch):
    monkeypatch.setattr(op, "TILE", 5)
    rng = random.Random(3)
    cells = {(r, c) for r in range(40) for c in range(40) if rng.random() < 0.55}
    got = {(r.row_i, r.col_i): r.component for r in op.components(grid(spark, cells), 40, eight).collect()}
    assert got == {k: v[0] * 40 + v[1] for k, v in flood(cells, eight).items()}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A snake through over 100 tiles is one component in few rounds, and no old round's table stays."""
    monkeypatch.setattr(op, "TILE", 4)
    tables = []
    monkeypatch.setattr(op, "written", lambda df, path=None: tables.append(path or "") or scratch.written(df, path))
    cells = snake(10, 40)
    got = op.components(grid(spark, cells), 40)
    assert got.select("component").distinct().collect() == [(0,)] and got.count() == len(cells)
    rounds = [p for p in tables if p.rsplit("/", 1)[-1].isdigit()]
    assert 2 <= len(rounds) <= 12


def test_rings_of_a_component_with_holes(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 4)
    cells = {(r, c) for r in range(20) for c in range(30)} - {(5, 5), (6, 6), (7, 6), (7, 7), (15, 20), (15, 21)} | {(40, 40)}
    labelled = op.components(grid(spark, cells), 64)
    rings = sorted((r.component, r.sides, r.area, r.hole) for r in op.outlines(labelled).collect())
    assert rings == [(0, 6, 2.0, True), (0, 12, 4.0, True), (0, 100, 600.0, False), (40 * 64 + 40, 4, 1.0, False)]  # holes that touch at a corner share a ring
    points = op.ring_points(labelled)
    for ring in {(r.component, r.ring) for r in points.collect()}:
        own = points.where((F.col("component") == ring[0]) & (F.col("ring") == ring[1])).orderBy("nth").collect()
        assert [r.nth for r in own] == list(range(len(own))) and all((a.r2, a.c2) == (b.r, b.c) for a, b in zip(own, own[1:] + own[:1]))
    shapes = {r.component: json.loads(r.geometry) for r in op.geojson(points, 10.0, 500.0, 900.0).collect()}
    outer, *holes = shapes[0]["coordinates"]
    assert outer[0] == outer[-1] and {tuple(p) for p in outer} == {(500.0, 900.0), (800.0, 900.0), (800.0, 700.0), (500.0, 700.0)} and sorted(len(h) for h in holes) == [5, 11]


def test_a_long_ring_is_walked_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 4)
    cells = snake(6, 24)
    labelled = op.components(grid(spark, cells), 40)
    (ring,) = op.outlines(labelled).collect()
    sides = sum((r + dr, c + dc) not in cells for r, c in cells for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert (ring.sides, ring.area, ring.hole) == (sides, float(len(cells)), False)


def world(seed, height=30, width=40):
    rng = np.random.default_rng(seed)
    level = np.where(rng.random((height, width)) < 0.9, 41 + np.add.outer(np.arange(height), np.arange(width)) % 40 * 0.5, -96.0)
    return level, [("road", r, c, float(level[r, c])) for r in range(height) for c in range(width)]


@pytest.mark.parametrize("size", [1, 3])
def test_squares_match_a_greedy_pick(spark, size):
    level, rows = world(5)
    cells = spark.createDataFrame(rows, "source string, row_i long, col_i long, raw double")
    half, want = size // 2 + 1, {}
    for r in range(half, level.shape[0] - half):
        for c in range(half, level.shape[1] - half):
            box = level[r - half : r + half + 1, c - half : c + half + 1]
            if (box > 0).all():
                ring = max(box[0].max(), box[-1].max(), box[:, 0].max(), box[:, -1].max())
                want[r, c] = (ring, "near_reporting_floor" if ring <= 45 else "higher_reported")
    found = op.candidate_squares(cells, size)
    assert {(r.row_i, r.col_i): (r.ring_max, r.stratum) for r in found.collect()} == want and len({s for _, s in want.values()}) == 2
    turn = {(r.row_i, r.col_i): r.h for r in found.select("row_i", "col_i", F.xxhash64(F.lit("s"), "source", "row_i", "col_i").alias("h")).collect()}
    taken = []
    for r, c in sorted(want, key=lambda k: (want[k][1] != "near_reporting_floor", turn[k], k)):
        if all(max(abs(r - y), abs(c - x)) > size + 1 for y, x in taken):
            taken.append((r, c))
    got = op.disjoint_squares(found, size, 40, 30, "s")
    assert {(r.row_i, r.col_i) for r in got.collect()} == set(taken) and len(taken) > 5
    assert op.disjoint_squares(found.limit(0), size, 40, 30).count() == 0


def test_squares_are_decided_in_few_passes_over_candidates(spark, monkeypatch):
    """Tiles of 6 cells that see 2 around: the same squares as one tile gives, from tables of candidates and not of the raster."""
    _, rows = world(6, 60, 50)
    cells = spark.createDataFrame(rows, "source string, row_i long, col_i long, raw double")
    want = {(r.row_i, r.col_i) for r in op.disjoint_squares(op.candidate_squares(cells, 1), 1, 50, 60).collect()}
    tables = []
    monkeypatch.setattr(op, "written", lambda df, path=None: (tables.append(scratch.written(df, path)), tables[-1])[1])
    monkeypatch.setattr(op, "TILE", 6)
    monkeypatch.setattr(op, "HALO", 2)
    found = op.candidate_squares(cells, 1)
    got = {(r.row_i, r.col_i) for r in op.disjoint_squares(found, 1, 50, 60).collect()}
    assert got == want and len(got) > 20
    sizes, n = [t.count() for t in tables], found.count()
    assert 3 <= len(sizes) <= 10 and max(sizes) <= n < 60 * 50


def test_estimates_of_a_square(spark):
    """Nearest and inverse-distance by hand, harmonic by relaxation; the summary's 90 % is over patches."""
    level, rows = world(8)
    cells = spark.createDataFrame(rows, "source string, row_i long, col_i long, raw double")
    squares = op.disjoint_squares(op.candidate_squares(cells, 3), 3, 40, 30)
    hidden = op.hidden_cells(squares, cells, 3)
    got = {}
    for x in op.interpolated(cells, hidden, 3).collect():
        got.setdefault(x.patch, {})[x.row_i, x.col_i] = x
    assert len(got) == squares.count()
    for square in squares.collect():
        r, c = square.row_i, square.col_i
        box = level[r - 2 : r + 3, c - 2 : c + 3].copy()
        ring = [(i, j) for i in range(5) for j in range(5) if i in (0, 4) or j in (0, 4)]
        box[1:4, 1:4] = 50
        for _ in range(400):
            box[1:4, 1:4] = (box[:3, 1:4] + box[2:, 1:4] + box[1:4, :3] + box[1:4, 2:]) / 4
        for (row, col), x in got[f"3:{r}:{c}"].items():
            i, j = row - r + 2, col - c + 2
            near = sorted(ring, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p))[:8]
            weight = [1 / ((p[0] - i) ** 2 + (p[1] - j) ** 2) for p in near]
            value = [level[r - 2 + p[0], c - 2 + p[1]] for p in near]
            assert x.nearest == value[0] and x.idw == pytest.approx(np.dot(weight, value) / sum(weight)) and x.harmonic == pytest.approx(box[i, j], abs=1e-9)
    strata = squares.select("source", F.concat_ws(":", F.lit(3), "row_i", "col_i").alias("patch"), F.lit(3).alias("size"), "stratum")
    for s in op.patch_summary(op.interpolated(cells, hidden, 3), strata).where("method = 'nearest'").collect():
        own = {f"3:{q.row_i}:{q.col_i}" for q in squares.where(F.col("stratum") == s.stratum).collect()}
        mae = [np.mean([abs(x.nearest - x.raw) for x in got[p].values()]) for p in own]
        assert s.patches == len(own) and s.patch_mae_p90 == pytest.approx(np.quantile(mae, 0.9)) and s.cells == 9 * len(own)


def test_enclosed_components_of_every_source(spark):
    rows = [("aircraft", r, c, -96.0 if 2 <= r <= 5 and 2 <= c <= 9 or (r, c) in ((0, 5), (12, 12)) else 44.0 + (r > 8)) for r in range(20) for c in range(20)]
    cells = spark.createDataFrame(rows, "source string, row_i long, col_i long, raw double")
    got = sorted((r.cells, r.ring_cells, r.size, r.ring) for r in op.enclosed(cells, 20, 20).collect())
    assert got == [(1, 8, "1-4", "lowest_5db_band"), (32, 28, "26-100", "lowest_5db_band")]
    assert [tuple(r) for r in op.inventory(op.enclosed(cells, 20, 20)).orderBy("size").collect()] == [("aircraft", "1-4", "lowest_5db_band", 1, 1), ("aircraft", "26-100", "lowest_5db_band", 1, 32)]


def test_patches_without_a_known_cell_around_have_no_estimates(spark):
    cells = [("road", r, c, 40.0 + r + c) for r in range(4) for c in range(4)] + [("rail", r, c, 50.0 if r in (1, 2) and c in (1, 2) else -96.0) for r in range(4) for c in range(4)]
    cells = spark.createDataFrame(cells, "source string, row_i long, col_i long, raw double")
    held = cells.where("row_i in (1, 2) and col_i in (1, 2)").selectExpr("source", "'0:0' as patch", "row_i", "col_i", "raw")
    got = op.interpolated(cells, held, 2).collect()
    assert [r.source for r in got] == ["road"] * 4 and all(abs(r.harmonic - r.raw) < 1e-9 for r in got)
