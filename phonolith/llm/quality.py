"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The fit reads a bounded sample of labelled rows, which are found before any statistics are computed: each partition
sums its own normal equations, and only those sums, of fixed size, reach the driver. The sample is halved by hash; each
half is scored by the other half's fit, and those scores are what the calibration sees. All documents are then scored in
one pass over their texts; ids and other columns never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolith.llm.common import Scratch, fold, ngram_hashes, utf8, word_hashes

#: The fit reads about so many labelled rows at most, chosen by a hash of doc_id.
TRAIN_ROWS = 50_000
FEATURES = 256
RIDGE = 1.0
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
_PARTS = 16
#: Texts whose features are held at once.
_TEXTS = 256

_CLASS = np.zeros(256, np.int8)  # 0 symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 non-ASCII, 7 plain punctuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 7
_GAP = (_CLASS == 4) | (_CLASS == 5)
N_STATS = 22


def statistics(text: str | pa.Scalar | None) -> np.ndarray:
    """Shape of a text in numbers: sizes, character classes, repetition of words, runs and lines."""
    data = utf8(text)
    if not len(data):
        return np.zeros(N_STATS)
    kinds = np.bincount(_CLASS[data], minlength=8) / len(data)
    words = word_hashes(text)
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    n = max(1, len(words))
    _, counts = np.unique(words, return_counts=True) if len(words) else (None, np.zeros(1))
    runs = ngram_hashes(words, 3)
    last = data[ends - 1] if len(ends) else np.zeros(1, np.uint8)
    lines = data.tobytes().split(b"\n")
    freq = np.bincount(data, minlength=256) / len(data)
    freq = freq[freq > 0]
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), sizes.mean() if len(sizes) else 0, sizes.std() if len(sizes) else 0, *kinds,
        len(counts) / n, counts.max() / n, len(np.unique(runs)) / max(1, len(runs)), len(set(lines)) / len(lines), np.log1p(len(lines)),
        np.mean(_CLASS[last] == 7), np.mean(_CLASS[last] == 0), np.mean(sizes == 1) if len(sizes) else 0,
        -(freq * np.log2(freq)).sum(), freq.max(),
    ])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))


def _projection(n_stats: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.normal(0, 1 / np.sqrt(n_stats), (n_stats, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Features whose inner products approximate a Gaussian kernel over standardised statistics, and a constant."""
    w, shift = _projection(stats.shape[1])
    z = np.clip((stats - mean) / sd, -5, 5)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + shift), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of y on x: adjacent violators are pooled; equal x are one point."""
    x, of = np.unique(x, return_inverse=True)
    sums, sizes = np.bincount(of, y), np.bincount(of)
    pools: list[tuple[float, float, float]] = []
    for at, total, n in zip(x * sizes, sums, sizes.astype(float), strict=True):
        while pools and pools[-1][1] * n >= total * pools[-1][2]:
            a, t, m = pools.pop()
            at, total, n = at + a, total + t, n + m
        pools.append((at, total, n))
    return np.array([a / n for a, _, n in pools]), np.array([t / n for _, t, n in pools])


class Model:
    """What the fit leaves: of fixed size, but for the calibration's pools, of which there are at most as many as rows fitted."""

    def __init__(self, mean, sd, weights, knots, values):
        self.mean, self.sd, self.weights, self.knots, self.values = mean, sd, weights, knots, values

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(fourier(stats, self.mean, self.sd) @ self.weights, self.knots, self.values), 0, 1)

    def scorer(self):
        """A Column function from texts to scores."""

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            parts = [self.score(np.stack([statistics(t) for t in texts.slice(i, _TEXTS)])) for i in range(0, len(texts), _TEXTS)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return score


def _solve(a: np.ndarray) -> np.ndarray:
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(a[:, :-1] + ridge, a[:, -1])


def fit(spark: SparkSession, scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS) -> Model | float:
    """The model, or the share of label 1 when the labelled rows do not hold both labels (0.5 without any)."""
    known = labels.select(F.col("doc_id").cast("long").alias("known_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(fold("known_id", FOLDS) != HELD_OUT)
    known = known.groupBy("known_id").agg(F.max("label").alias("label"))
    count = known.count()
    share = int(1_000_000 * min(1.0, train_rows / max(1, count)))
    sample = known.where(F.pmod(F.xxhash64("known_id", F.lit(3)), F.lit(1_000_000)) < share)
    half = F.pmod(F.xxhash64("known_id", F.lit(4)), F.lit(2)).cast("int")
    own = docs.select(F.col("doc_id").cast("long").alias("known_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "known_id")  # about train_rows rows of two numbers
    rows = own.select("known_id", "label", half.alias("half"), statistics_of("text").alias("stats"))
    rows = scratch.keep(rows.repartition(_PARTS, "known_id").sortWithinPartitions("known_id", "stats").select("label", "half", "stats"), "train")
    columns = [F.col("stats")[i] for i in range(N_STATS)]
    got = rows.agg(F.count(F.lit(1)), F.avg("label"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    if not got[0] or got[1] in (0.0, 1.0):
        return 0.5 if not got[0] else float(got[1])
    mean, sd = np.array(got[2 : 2 + N_STATS]), np.maximum(np.array(got[2 + N_STATS :]), 1e-6)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            z = fourier(batch.column("stats").flatten().to_numpy().reshape(-1, N_STATS), mean, sd)
            yield z, batch.column("label").to_numpy().astype(float), batch.column("half").to_numpy()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for z, y, half in parted(batches):
            for h in (0, 1):
                total[h] += z[half == h].T @ np.column_stack([z, y])[half == h]
        yield pa.RecordBatch.from_pydict({"half": pa.array([0, 1], pa.int32()), "sums": [total[0].tobytes(), total[1].tobytes()]})

    parts = sorted((r.half, bytes(r.sums)) for r in rows.coalesce(_PARTS).mapInArrow(sums, "half int, sums binary").collect())
    by_half = [sum(np.frombuffer(s).reshape(FEATURES + 1, FEATURES + 2) for h, s in parts if h == k) for k in (0, 1)]
    crossed = [_solve(by_half[1]), _solve(by_half[0])]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, y, half in parted(batches):
            yield pa.RecordBatch.from_pydict({"raw": np.where(half == 0, z @ crossed[0], z @ crossed[1]), "label": y})

    seen = np.array(rows.mapInArrow(held, "raw double, label double").collect())
    knots, values = isotonic(seen[:, 0], seen[:, 1])
    return Model(mean, sd, _solve(by_half[0] + by_half[1]), knots, values)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Labels are learned from rows whose crc32(doc_id) modulo 4 is not 2. A null or empty text has all statistics zero
    and is scored like any other. A null doc_id counts as fold 0; a doc_id that repeats in labels counts once, with
    its larger label. Without labels of both kinds every score is the share of label 1, or 0.5 without any. An empty
    table gives an empty result. Other columns are ignored.
    """
    model = fit(spark, Scratch(spark), docs, labels, label)
    score = model.scorer()(F.col("text").cast("string")) if isinstance(model, Model) else F.lit(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose predicted quality is 0; all columns of docs stay.

    Without labels to learn from nothing is rejected; if all of them are 0, everything is.
    """
    model = fit(spark, Scratch(spark), docs, labels, "quality")
    if not isinstance(model, Model):
        return docs.limit(0) if model == 0.0 else docs
    return docs.where(model.scorer()(F.col("text").cast("string")) >= THRESHOLD)
