"""Folds over squares of cells, in tiles with what lies within reach of them."""

import random

import pytest
from pyspark.sql import functions as F

from phonolith.operators import cells as op


@pytest.fixture(scope="module")
def ragged(spark):
    """Cells with gaps around the corner of four tiles, of two sources."""
    random.seed(5)
    rows = [(r, c, s, random.choice([-96.0, 0.0, 41.25, 55.5, 77.0])) for s in ("road", "rail") for r in range(-3, 134) for c in range(122, 134) if random.random() < 0.7]
    return rows, spark.createDataFrame(rows, "row_i long, col_i long, source string, raw double").cache()


def test_folds_equal_a_search(ragged):
    rows, cells = ragged
    at = {(s, r, c): v for r, c, s, v in rows}
    square = lambda s, r, c, n: [(i, j, at[s, r + i, c + j]) for i in range(-n, n + 1) for j in range(-n, n + 1) if (s, r + i, c + j) in at]
    means = {(x.source, x.row_i, x.col_i): (x.n, x.mean_db) for x in op.moving_means(cells).collect()}
    ends = {(x.source, x.row_i, x.col_i): (x.low, x.high) for x in op.square_range(cells).collect()}
    far = {(x.source, x.row_i, x.col_i): x.d2 for x in op.clearance(cells, F.col("raw") >= 75, 3).collect()}
    assert set(means) == set(ends) == set(far) == set(at)
    for k in at:
        v = [x for _, _, x in square(*k, 2) if x > 0]
        assert means[k][0] == len(v) and means[k][1] == (pytest.approx(sum(v) / len(v)) if v else None)
        v = [x for _, _, x in square(*k, 1) if x > 0]
        assert ends[k] == ((min(v), max(v)) if v else (None, None))
        d = [i * i + j * j for i, j, x in square(*k, 3) if x >= 75]
        assert far[k] == (min(d) if d and min(d) <= 9 else None)


def test_cells_go_out_to_tiles_only(ragged):
    """No join and no row for every place within reach of a cell."""
    _, cells = ragged
    for out in (op.moving_means(cells), op.square_range(cells), op.clearance(cells, F.col("raw") >= 75, 3), op.quietest(cells, 3, F.col("raw") > 0, F.col("raw") >= 75)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
