"""Regressions whose likelihoods are summed on the executors; the driver holds coefficients only."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.sources.scratch import folder, removed, written


def standardise(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean over their standard deviation (1 where it is 0), and the two for each; nulls stay."""
    got = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    scale = {c: (got[i] or 0.0, got[len(columns) + i] or 1.0) for i, c in enumerate(columns)}
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x])


def _terms(x: np.ndarray, y: np.ndarray, below: np.ndarray, w: np.ndarray, beta: np.ndarray, log_sd: float, floor: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and outer products of scores of a left-censored Gaussian model over some rows."""
    sd, eta = math.exp(log_sd), x @ beta
    soft = np.logaddexp(0, eta) if floor is not None else eta
    mu, slope = (floor + soft, 1 / (1 + np.exp(-eta))) if floor is not None else (eta, np.ones(len(eta)))
    z = (y - mu) / sd
    like, d_mu, d_sd = -z * z / 2 - log_sd - 0.5 * math.log(2 * math.pi), z / sd, z * z - 1
    cut = z[below]  # only censored rows need the distribution function
    pdf = np.exp(-cut * cut / 2) / math.sqrt(2 * math.pi)
    cdf = np.maximum(0.5 * (1 + _erf(cut / math.sqrt(2))), 1e-12)
    like[below], d_mu[below], d_sd[below] = np.log(cdf), -pdf / cdf / sd, -cut * pdf / cdf
    score = np.column_stack([x * (d_mu * slope)[:, None], d_sd])
    return float(w @ like), score.T @ w, (score * w[:, None]).T @ score


def _sums(own: DataFrame, beta: np.ndarray, log_sd: float, floor: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Likelihood, gradient and outer products of scores over all rows: sums by partition, then one small row to the driver."""
    k = len(beta) + 1

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 + k + k * k)
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), *[pdf[f"x{i}"].to_numpy() for i in range(1, len(beta))]])
                a, g, h = _terms(x, pdf.y.to_numpy(), pdf.below.to_numpy(bool), pdf.w.to_numpy(), beta, log_sd, floor)
                out += np.concatenate([[a], g, h.ravel()])
        yield pd.DataFrame({"i": np.arange(len(out)), "v": out})

    sums = own.mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
    return sums[0], sums[1 : 1 + k], sums[1 + k :].reshape(k, k)


def _free_step(at: np.ndarray, gradient: np.ndarray, products: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A step of the outer-product approximation over the coefficients that no bound holds; those that it would push past one stay."""
    free = ~((at <= low) & (gradient < 0) | (at >= high) & (gradient > 0))
    step = np.zeros(len(at))
    if free.any():
        step[free] = np.linalg.solve(products[np.ix_(free, free)] + 1e-6 * np.eye(free.sum()), gradient[free])
    return step


def censored_regression(
    df: DataFrame, features: Sequence[str], level: str, below: str, weight: str, floor: float | None = None, steps: int = 25, tolerance: float = 1e-6,
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
) -> tuple[np.ndarray, float]:
    """Coefficients (constant first) and standard deviation; with a floor the mean is floor + softplus(x b).

    bounds: least and greatest coefficient by feature (None: free). Each step sums the likelihood, its gradient and the
    scores' outer products by partition; only those sums reach the driver. It takes a step over the coefficients that no
    bound holds back (the active set is chosen anew each time), brings what leaves the bounds back onto them, and halves the
    step until the likelihood does not fall. Rows are written once and read by every step. The logarithm of the deviation
    stays within -5 and 5. Rows without a level, a feature or a positive weight raise ValueError, as do bounds that cross.
    """
    home = folder(df.sparkSession)
    named = [f"x{i}" for i in range(1, len(features) + 1)]  # plain columns reach numpy without an object for each row
    own = df.select(*[F.col(f).cast("double").alias(x) for f, x in zip(features, named, strict=True)], F.col(level).cast("double").alias("y"), F.col(below).alias("below"), F.col(weight).cast("double").alias("w"))
    own = written(own, home)
    bad = " or ".join(f"{c} is null or isnan({c})" for c in ("y", *named))
    if not own.where(f"below is null or not coalesce(w > 0, false) or {bad}").isEmpty():
        raise ValueError("every row needs a level, features and a positive weight")
    limit = [(bounds or {}).get(f, (None, None)) for f in features]
    low = np.array([-np.inf, *(-np.inf if a is None else a for a, _ in limit), -5.0])
    high = np.array([np.inf, *(np.inf if b is None else b for _, b in limit), 5.0])
    if (low > high).any():
        raise ValueError("a least coefficient is above the greatest")
    mean, sd = own.agg(F.avg("y"), F.stddev_pop("y")).first()
    at = np.zeros(len(low))
    at[0] = (mean or 0.0) if floor is None else math.log(math.expm1(max((mean or 0.0) - floor, 0.1)))
    at[-1] = math.log(sd or 1.0)
    at = np.clip(at, low, high)
    now = _sums(own, at[:-1], at[-1], floor)
    for _ in range(steps):
        step, size = _free_step(at, now[1], now[2], low, high), 1.0
        while size > 1e-3:
            there = np.clip(at + size * step, low, high)
            new = _sums(own, there[:-1], there[-1], floor)
            if new[0] >= now[0]:
                break
            size /= 2
        else:
            break
        gain, at, now = new[0] - now[0], there, new
        if gain <= tolerance * abs(now[0]):
            break
    removed(df.sparkSession, home)
    return at[:-1], math.exp(at[-1])


def held_out(df: DataFrame, by: str, features: Sequence[str], level: str, below: str, weight: str, cutoff: Column, floor: float | None = None, most: int = 64, **fit) -> DataFrame:
    """Predictions of every row by a model that was fitted without its group: leave one group out, for each group.

    Scaling is taken from the rows that the fit sees. Every group costs a fit over the others, so more than `most` raise
    ValueError; groups without an observed row keep their predictions. Rows without a group are in no fit and get none.
    """
    home = folder(df.sparkSession)
    own = written(df.where(F.col(by).isNotNull()), home)  # read by every fit, and by what is returned
    groups = [r[0] for r in own.select(by).distinct().limit(most + 1).collect()]
    if len(groups) > most:
        raise ValueError(f"more than {most} groups")
    out = None
    for g in sorted(groups):
        seen, scale = standardise(own.where(F.col(by) != g), features)
        beta, sd = censored_regression(seen, features, level, below, weight, floor, **fit)
        rest = own.where(F.col(by) == g).withColumns({f: (F.col(f) - m) / s for f, (m, s) in scale.items()})
        held = predict(rest, features, beta, sd, cutoff, floor)
        out = held if out is None else out.unionByName(held)
    return out if out is not None else predict(own, features, np.zeros(len(features) + 1), 1.0, cutoff, floor)


def least_squares(df: DataFrame, features: Sequence[str], level: str) -> np.ndarray:
    """Ordinary least squares, constant first: products are summed on the executors, the driver solves for the coefficients."""
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k, y = len(columns), F.col(level).cast("double")
    got = df.dropna(subset=[*features, level]).agg(*[F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)], *[F.sum(a * y).alias(f"q{i}") for i, a in enumerate(columns)]).first()
    return np.linalg.lstsq(np.array(got[: k * k], float).reshape(k, k), np.array(got[k * k :], float), rcond=None)[0]


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def predict(df: DataFrame, features: Sequence[str], beta: np.ndarray, sd: float, cutoff: Column, floor: float | None = None) -> DataFrame:
    """Mean, chance of lying below the cutoff, and the 80 % interval."""
    eta = F.lit(float(beta[0]))
    for b, f in zip(beta[1:], features, strict=True):
        eta = eta + float(b) * F.col(f)
    mu = eta if floor is None else floor + F.log1p(F.exp(-F.abs(eta))) + F.greatest(eta, F.lit(0.0))
    out = df.withColumn("mean_db", mu)
    return out.withColumns({"p_below": normal_cdf((cutoff - F.col("mean_db")) / sd), "low_db": F.col("mean_db") - 1.2815515655446004 * sd, "high_db": F.col("mean_db") + 1.2815515655446004 * sd})


def stratified(df: DataFrame, strata: Sequence[str], key: str, count: int, seed: int = 1) -> DataFrame:
    """`count` rows of each stratum in hash order, with the weight that each stands for: stratum size over sample size."""
    order = W.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    whole = W.partitionBy(*strata)
    out = df.withColumns({"_n": F.row_number().over(order), "_all": F.count(F.lit(1)).over(whole)}).where(F.col("_n") <= count)
    return out.withColumn("weight", F.col("_all") / F.least(F.col("_all"), F.lit(count))).drop("_n", "_all")


def error_metrics(df: DataFrame, by: Sequence[str], observed: str, predicted: str, weight: str, chance: str | None = None, happened: str | None = None) -> DataFrame:
    """Weighted MAE, RMSE, bias, effective n, Spearman's correlation as the correlation of average ranks, and the Brier score of a chance."""
    group = list(by)
    average = lambda c: F.rank().over(W.partitionBy(*group).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*group, c)) - 1) / 2
    e, w = F.col(predicted) - F.col(observed), F.col(weight)
    own = df.withColumns({"_e": e, "_ro": average(observed), "_rp": average(predicted)})
    return own.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(w * F.abs("_e")) / F.sum(w)).alias("mae"), F.sqrt(F.sum(w * F.col("_e") * F.col("_e")) / F.sum(w)).alias("rmse"),
        (F.sum(w * F.col("_e")) / F.sum(w)).alias("bias"), F.percentile(F.abs("_e"), F.lit(0.5)).alias("median_ae"), F.percentile(F.abs("_e"), F.lit(0.9)).alias("p90"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"), F.try_divide(F.covar_pop("_ro", "_rp"), F.stddev_pop("_ro") * F.stddev_pop("_rp")).alias("spearman"),
        *([(F.sum(w * (F.col(chance) - F.col(happened).cast("double")) ** 2) / F.sum(w)).alias("brier")] if chance and happened else []),
    )


def sliced_errors(df: DataFrame, slices: Sequence[str], observed: str, predicted: str, weight: str) -> DataFrame:
    """Errors of every slice, each value of each column of `slices`, and of all rows, in one pass by grouping sets.

    `slice` names the column (all: every row) and `value` its value as text; a null value is a value like others.
    """
    e, w = F.col("_e"), F.col(weight)
    own = df.withColumn("_e", F.col(predicted) - F.col(observed)).select("_e", weight, *[F.col(c).cast("string").alias(c) for c in slices])
    sets = [[F.col(c)] for c in slices] + [[]]
    out = own.groupingSets(sets, *slices).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), (F.sum(w * F.abs(e)) / F.sum(w)).alias("mae"), F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"), (F.sum(w * e) / F.sum(w)).alias("bias"),
        F.percentile(F.abs(e), F.lit(0.9)).alias("p90"),
    )
    last = len(slices) - 1  # a bit is set for each column that a set leaves out
    kept = lambda i: F.col("_set").bitwiseAND(F.lit(1 << (last - i))) == 0
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(slices))):
        name, value = F.when(kept(i), F.lit(c)).otherwise(name), F.when(kept(i), F.col(c)).otherwise(value)
    return out.select(name.alias("slice"), value.alias("value"), "n", "mae", "rmse", "bias", "p90")


def calibration(df: DataFrame, by: Sequence[str], chance: str, happened: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins of a predicted chance with what was predicted and what happened."""
    tile = F.ntile(bins).over(W.partitionBy(*by).orderBy(chance, key))
    return df.withColumn("bin", tile).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(chance).alias("predicted"), F.avg(F.col(happened).cast("double")).alias("observed"))
