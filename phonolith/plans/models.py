"""Queries over receptors with their exposure and an observed level."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.operators import models as op
from phonolith.operators import spatial
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx
from phonolith.sources.scratch import written

#: Receptors with an exact integer stand-in for a level and a prediction, so that both engines sum the same numbers.
ROWS = """
select c_custkey key, cast(c_nationkey as bigint) region, cast(mod(c_custkey * 37, 6000) as double) / 100 observed,
  cast(mod(c_custkey * 37, 6000) + mod(c_custkey * 101, 900) - 450 as double) / 100 predicted, cast(1 + mod(c_custkey, 4) as double) weight from {customer}
"""


@query("ag30_ag31_wn16_error_metrics", ROWS, """
with r as (select *, predicted - observed e, rank() over (partition by region order by observed) + (count(*) over (partition by region, observed) - 1) / 2 ro,
  rank() over (partition by region order by predicted) + (count(*) over (partition by region, predicted) - 1) / 2 rp from {t} x)
select region, count(*) n, round(sum(weight * abs(e)) / sum(weight), 6) mae, round(sqrt(sum(weight * e * e) / sum(weight)), 6) rmse, round(sum(weight * e) / sum(weight), 6) bias, round(quantile_cont(abs(e), 0.5), 6) median_ae,
  round(quantile_cont(abs(e), 0.9), 6) p90, round(sum(weight) * sum(weight) / sum(weight * weight), 6) effective_n, round(corr(ro, rp), 6) spearman from r group by 1""")
def _(rows):
    out = op.error_metrics(rows, ["region"], "observed", "predicted", "weight")
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias", "median_ae", "p90", "effective_n", "spearman")})


@query("ag30_band_slices", ROWS, """
with b as (select *, floor(observed / 10)::bigint * 10 band, weight / 5 chance, predicted > 30 loud from {t} x),
r as (select *, predicted - observed e, rank() over (partition by band order by observed) + (count(*) over (partition by band, observed) - 1) / 2 ro, rank() over (partition by band order by predicted) + (count(*) over (partition by band, predicted) - 1) / 2 rp from b)
select band, count(*) n, round(sum(weight * abs(e)) / sum(weight), 6) mae, round(sqrt(sum(weight * e * e) / sum(weight)), 6) rmse, round(sum(weight * e) / sum(weight), 6) bias, round(quantile_cont(abs(e), 0.5), 6) median_ae,
  round(quantile_cont(abs(e), 0.9), 6) p90, round(sum(weight) * sum(weight) / sum(weight * weight), 6) effective_n, round(corr(ro, rp), 6) spearman, round(sum(weight * pow(chance - loud::int, 2)) / sum(weight), 6) brier from r group by 1""")
def _(rows):
    own = rows.withColumns({"band": F.floor(F.col("observed") / 10) * 10, "chance": F.col("weight") / 5, "loud": F.col("predicted") > 30})
    out = op.error_metrics(own, ["band"], "observed", "predicted", "weight", "chance", "loud")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("band", "n")})


@query("ag31_error_slices", ROWS, """
with r as (select *, predicted - observed e, region::varchar r1, (floor(observed / 10) * 10)::bigint::varchar r2, (weight >= 3)::varchar r3 from {t} x),
l as (select 'region' slice, r1 "value", e, weight from r union all select 'band', r2, e, weight from r union all select 'heavy', r3, e, weight from r union all select 'all', null, e, weight from r)
select slice, "value", count(*) n, round(sum(weight * abs(e)) / sum(weight), 6) mae, round(sqrt(sum(weight * e * e) / sum(weight)), 6) rmse, round(sum(weight * e) / sum(weight), 6) bias, round(quantile_cont(abs(e), 0.9), 6) p90 from l group by 1, 2""")
def _(rows):
    own = rows.withColumns({"band": (F.floor(F.col("observed") / 10) * 10).cast("long"), "heavy": F.col("weight") >= 3})
    return op.sliced_errors(own, ["region", "band", "heavy"], "observed", "predicted", "weight").withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias", "p90")})


@query("ag32_calibration_bins", ROWS, """
with r as (select *, ntile(10) over (partition by region order by predicted, "key")::int bin from {t} x)
select region, bin, count(*) n, round(avg(predicted), 6) predicted, round(avg((observed > 30)::int), 6) observed from r group by 1, 2""")
def _(rows):
    own = rows.withColumn("loud", F.col("observed") > 30)
    return op.calibration(own, ["region"], "predicted", "loud", "key").withColumns({c: F.round(c, 6) for c in ("predicted", "observed")})


@query("ml1_standardised", ROWS, """
select "key", round((observed - (select avg(observed) from {t} x)) / (select stddev_pop(observed) from {t} x), 6) observed, round((predicted - (select avg(predicted) from {t} x)) / (select stddev_pop(predicted) from {t} x), 6) predicted from {t} y""")
def _(rows):
    out, _ = op.standardise(rows, ["observed", "predicted"])
    return out.select("key", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


@query("ml7_stratified_weights", ROWS, """
with r as (select region, count(*) n from {t} x group by 1) select region, least(n, 20) sampled, round(n / least(n, 20), 6) weight from r""")
def _(rows):
    out = op.stratified(rows.drop("weight"), ["region"], "key", 20)
    return out.groupBy("region").agg(F.count(F.lit(1)).alias("sampled"), F.round(F.first("weight"), 6).alias("weight"))


@query("ag40_model_disagreement", ROWS, """
with m as (select region, "key", (observed + predicted + (predicted + 1)) / 3 mean, observed a, predicted b, predicted + 1 c from {t} x)
select region, round(quantile_cont(sqrt((pow(a - mean, 2) + pow(b - mean, 2) + pow(c - mean, 2)) / 3), 0.5), 6) median_sd, round(quantile_cont(sqrt((pow(a - mean, 2) + pow(b - mean, 2) + pow(c - mean, 2)) / 3), 0.9), 6) p90_sd from m group by 1""")
def _(rows):
    a, b, c = F.col("observed"), F.col("predicted"), F.col("predicted") + 1
    mean = (a + b + c) / 3
    sd = F.sqrt((F.pow(a - mean, F.lit(2)) + F.pow(b - mean, F.lit(2)) + F.pow(c - mean, F.lit(2))) / 3)
    own = rows.withColumn("sd", sd)
    return own.groupBy("region").agg(F.round(F.percentile("sd", F.lit(0.5)), 6).alias("median_sd"), F.round(F.percentile("sd", F.lit(0.9)), 6).alias("p90_sd"))


def training(spark, d):
    """Receptors with two features of their exposure and a level that is censored at 40 dB; written once, as scaling, fit and prediction all read it."""
    points, links = fx.derived(spark, d, fx.RECEPTORS), fx.derived(spark, d, fx.LINKS)
    near = spatial.exposure(points.select("receptor_id", "x", "y"), links, 2000.0)
    own = points.join(near, "receptor_id").select("receptor_id", "region_id", F.log10(F.col("line_energy") + 1).alias("energy"), F.log10(F.col("nearest") + 10).alias("near"))
    noise = (F.pmod(F.xxhash64("receptor_id"), F.lit(2000)) - 1000) / 250.0
    level = 42.0 + 3.0 * F.col("energy") - 4.0 * F.col("near") + noise
    own = own.withColumn("level", F.round(level, 2))
    return written(own.withColumns({"below": F.col("level") < 40, "level": F.greatest("level", F.lit(40.0)), "weight": F.lit(1.0)}))


@query("ml2_ml4_censored_fit")
def _(spark, d):
    rows, _ = op.standardise(training(spark, d), ["energy", "near"])
    beta, sd = op.censored_regression(rows, ["energy", "near"], "level", "below", "weight")
    out = op.predict(rows, ["energy", "near"], beta, sd, F.lit(40.0))
    return out.select("receptor_id", *[F.round(c, 3).alias(c) for c in ("mean_db", "p_below", "low_db", "high_db")])


@query("ml3_floor_fit")
def _(spark, d):
    rows, _ = op.standardise(training(spark, d), ["energy", "near"])
    beta, sd = op.censored_regression(rows, ["energy", "near"], "level", "below", "weight", floor=35.0)
    return op.predict(rows, ["energy", "near"], beta, sd, F.lit(40.0), floor=35.0).select("receptor_id", *[F.round(c, 3).alias(c) for c in ("mean_db", "p_below")])


@query("ml2_bounded_fit")
def _(spark, d):
    """A coefficient of at most 0.1 for energy, and none above 0 for distance: the first bound holds."""
    rows, _ = op.standardise(training(spark, d), ["energy", "near"])
    beta, sd = op.censored_regression(rows, ["energy", "near"], "level", "below", "weight", bounds={"energy": (0.0, 0.1), "near": (None, 0.0)})
    out = op.predict(rows, ["energy", "near"], beta, sd, F.lit(40.0))
    return out.select("receptor_id", *[F.round(c, 3).alias(c) for c in ("mean_db", "p_below")])


@query("ml6_leave_one_region_out")
def _(spark, d):
    """Every region of the world predicted by a model of the others, scaled by what that model saw; errors by region."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("region_id"), F.col("n_regionkey").cast("long").alias("world"))
    rows = training(spark, d).join(nations, "region_id")
    out = op.held_out(rows, "world", ["energy", "near"], "level", "below", "weight", F.lit(40.0), steps=12)
    return op.error_metrics(out, ["world"], "level", "mean_db", "weight").select("world", "n", F.round("rmse", 3).alias("rmse"), F.round("bias", 3).alias("bias"), F.round("spearman", 3).alias("spearman"))
