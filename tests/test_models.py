"""Fits with bounds against a local search, and predictions of held-out groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.operators import models as op


def rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    level = 45 + 3.0 * a - 2.0 * b + 0.8 * rng.normal(size=n)
    return [(float(x), float(y), float(max(z, 42.0)), bool(z < 42.0), float(1 + i % 3), int(i % 4)) for i, (x, y, z) in enumerate(zip(a, b, level))]


SCHEMA = "a double, b double, level double, below boolean, weight double, region int"


def local(own, low, high, floor=None):
    """Projected gradient ascent with many small steps, until nothing moves."""
    x = np.array([[1.0, r[0], r[1]] for r in own])
    y, below, w = (np.array([r[i] for r in own]) for i in (2, 3, 4))
    at = np.clip(np.array([y.mean() if floor is None else math.log(math.expm1(y.mean() - floor)), 0.0, 0.0, 0.0]), low, high)
    size = 1e-3
    value, gradient, _ = op._terms(x, y, below, w, at[:-1], at[-1], floor)
    for _ in range(200_000):
        there = np.clip(at + size * gradient, low, high)
        new, g, _ = op._terms(x, y, below, w, there[:-1], there[-1], floor)
        if new < value:
            size /= 2
            if size < 1e-12:
                break
            continue
        moved = np.abs(there - at).max()
        at, value, gradient = there, new, g
        size *= 1.3
        if moved < 1e-12:
            break
    return at


@pytest.mark.parametrize("floor", [None, 30.0])
def test_a_fit_on_its_bounds(spark, floor):
    own = rows()
    top = 1.5 if floor is None else 1.2
    beta, sd = op.censored_regression(spark.createDataFrame(own, SCHEMA), ["a", "b"], "level", "below", "weight", floor, steps=60, tolerance=1e-13, bounds={"a": (0.0, top), "b": (-1.0, None)})
    want = local(own, np.array([-np.inf, 0.0, -1.0, -5.0]), np.array([np.inf, top, np.inf, 5.0]), floor)
    assert beta[1] == top and beta[2] == -1.0 and np.allclose([*beta, math.log(sd)], want, atol=1e-6)


def test_a_bound_that_does_not_bind_changes_nothing(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    free = op.censored_regression(df, ["a", "b"], "level", "below", "weight", steps=60, tolerance=1e-13)
    held = op.censored_regression(df, ["a", "b"], "level", "below", "weight", steps=60, tolerance=1e-13, bounds={"a": (-50.0, 50.0)})
    assert np.allclose(free[0], held[0], atol=1e-6) and free[1] == pytest.approx(held[1], abs=1e-6)


def test_bad_rows_and_bounds_are_refused(spark):
    df = spark.createDataFrame(rows(30), SCHEMA)
    with pytest.raises(ValueError, match="weight"):
        op.censored_regression(df.withColumn("weight", F.lit(0.0)), ["a"], "level", "below", "weight")
    with pytest.raises(ValueError, match="greatest"):
        op.censored_regression(df, ["a"], "level", "below", "weight", bounds={"a": (2.0, 1.0)})


def test_held_out_groups_are_not_seen(spark):
    """Levels of one region are shifted by 20 dB: the others' model does not know, and its scaling does not either."""
    own = [(r[0] + (50 if r[5] == 3 else 0), r[1], r[2] + (20 if r[5] == 3 else 0), False, 1.0, r[5]) for r in rows(160)]
    df = spark.createDataFrame(own, SCHEMA)
    got = op.held_out(df, "region", ["b"], "level", "below", "weight", F.lit(42.0))
    assert got.count() == 160
    off = {r.region: r.e for r in got.groupBy("region").agg(F.avg(F.col("level") - F.col("mean_db")).alias("e")).collect()}
    assert off[3] > 15 and all(off[k] < 0 for k in (0, 1, 2))
    with pytest.raises(ValueError, match="groups"):
        op.held_out(df, "region", ["b"], "level", "below", "weight", F.lit(42.0), most=3)


@pytest.mark.parametrize("floor", [None, 30.0])
def test_only_censored_rows_ask_for_the_distribution(monkeypatch, floor):
    own, asked, erf = rows(200), [], op._erf
    monkeypatch.setattr(op, "_erf", lambda x: (asked.append(len(x)), erf(x))[1])
    x, (y, below, w), beta, sd = np.array([[1.0, r[0], r[1]] for r in own]), (np.array([r[i] for r in own]) for i in (2, 3, 4)), np.array([44.0 if floor is None else 14.0, 2.5, -1.5]), 1.2
    got = op._terms(x, y, below, w, beta, math.log(sd), floor)[0]
    want = 0.0
    for r in own:
        eta = beta @ [1.0, r[0], r[1]]
        z = (r[2] - (eta if floor is None else floor + math.log1p(math.exp(eta)))) / sd
        want += r[4] * (math.log(0.5 * (1 + math.erf(z / math.sqrt(2)))) if r[3] else -z * z / 2 - math.log(sd) - 0.5 * math.log(2 * math.pi))
    assert asked == [sum(r[3] for r in own)] and 0 < asked[0] < 200 and math.isclose(got, want, rel_tol=1e-9)


def test_training_rows_are_joined_once(spark):
    """Scaling, every step of a fit and the prediction read what was written, not the distance join behind it."""
    from phonolith.plans.models import training

    out = training(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
