"""Toxicity by class-conditional Kneser-Ney bigram models.

Toxic and ordinary text each have a bigram model of their own, a distribution over the next word that sums to 1:

    P_c(w | h) = max(n'_c(h, w) - A, 0) / n'_c(h) + L_c(h) S_c(w | h)      own discounted counts
    S_c(w | h) = P(w | h) r_c(w) / Z_c(h)                                  backoff: shared, with the class's word marginals
    P(w | h)   = max(n(h, w) - D, 0) / n(h) + D t(h) / n(h) P(w)           interpolated Kneser-Ney over both classes
    P(w)       = max(t(w) - D, 0) / t + D words / t / (words + 1)          shared continuation counts

n' are the class's counts scaled so that both classes are equally large; A is a number of occurrences, so that what is rare
in a class is left to the backoff; L_c and Z_c make sums 1. r_c(w) is the class's rate of a word against the shared
one, with KAPPA occurrences of prior. A text's score is its log-likelihood under the toxic less that under the ordinary
model, by length, calibrated on labelled texts that were not counted.

Where both counts of a bigram are within A, shared probabilities cancel: its ratio is a number of the context plus a
number of the word. So the model is a table of words and a table of the bigrams above A, which both grow with the labelled
text. Frequent words, by their share of all words, go out with the tasks, as do the bigrams while they are few; all other
words of the texts, and bigrams beyond that, are joined to the tables. Shuffles of bigrams and of words go share by share,
so that disk holds a part of them beside the written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import Scratch, broadcast_if_small, fold, word_hashes
from phonolith.llm.quality import isotonic

DISCOUNT = 0.75
#: The classes' own discount A, in occurrences: the same however much text there is, so bigrams of a class grow with it.
OWN_DISCOUNT = 20.0
#: Occurrences that a class's rate of a word starts from: the more, the nearer a rare word's rate is to 1.
KAPPA = 2.0
#: A word is frequent if it makes up this share of all words or more, whatever else the vocabulary holds; so no more than its inverse are.
FREQUENT = 2.0**-20
#: Bigrams above A that go out with the tasks; where there are more, they are joined.
SENT_BIGRAMS = 1 << 20
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: One in so many labelled texts is not counted but calibrates ...
CALIBRATES = 4
#: ... of these, three numbers a row, about so many at most, chosen by a hash of doc_id.
CALIBRATION_ROWS = 50_000
#: Words that a task counts before it hands them on.
_FLUSH = 1_000_000
#: Bigrams are counted in so many passes over the labelled text, each for its share of the contexts, and words are looked up in as many, each for its
#: share of the keys: only one share is shuffled at a time.
SLICES = 4
#: Words come again within a file: with room for them in its dictionary, a table holds their numbers.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}
#: Bits by which a word's hash is turned before its context's is laid over it: hashes are mixed, so this is as good as a hash of both.
TURN = 21
START, END = np.uint64(0), np.uint64(1)


def words_of(text: str | pa.Scalar | None) -> np.ndarray:
    """Hashes of a text's words; punctuation, and words of nothing else, are left out."""
    hashes = word_hashes(text, strip=True)
    return hashes[hashes != 0]


def steps_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and next words of a text, from its start to its end."""
    return np.concatenate([[START], words]), np.concatenate([words, [END]])


def bigram_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return contexts ^ (words << np.uint64(TURN) | words >> np.uint64(64 - TURN))


def bigram_key(context: str, word: str) -> Column:
    """As bigram_keys, in Spark."""
    return F.col(context).bitwiseXOR(F.shiftleft(word, TURN).bitwiseOR(F.shiftrightunsigned(word, 64 - TURN)))


def _count(batches: Iterator[pa.RecordBatch], share: int, slices: int) -> Iterator[pa.RecordBatch]:
    """Bigrams of a share of the contexts with their numbers in ordinary and in toxic text, counted within the task."""
    held, labels, size = [], [], 0

    def counted() -> pa.RecordBatch:
        contexts, words = (np.concatenate(x) for x in zip(*map(steps_of, held), strict=True))
        own = contexts % np.uint64(slices) == share
        contexts, words = contexts[own], words[own]
        keys, first, of = np.unique(bigram_keys(contexts, words), return_index=True, return_inverse=True)
        toxic = np.repeat(np.array(labels, bool), [len(w) + 1 for w in held])[own]
        n1 = np.bincount(of[toxic], minlength=len(keys))
        n0 = np.bincount(of, minlength=len(keys)) - n1
        return pa.RecordBatch.from_pydict({"context": contexts[first].view(np.int64), "word": words[first].view(np.int64), "n0": n0, "n1": n1})

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            words = words_of(text)
            if len(words):
                held.append(words)
                labels.append(toxic)
                size += len(words)
            if size > _FLUSH:
                yield counted()
                held, labels, size = [], [], 0
    if held:
        yield counted()


@dataclass
class Models:
    """words: the written table (key, n, v) of what a word adds to a text's ratio; the rest is of bounded size."""

    words: DataFrame
    #: What every text adds, and what a word adds that was never counted.
    once: float
    unseen: float
    #: Keys and numbers of the frequent words.
    head: tuple[np.ndarray, np.ndarray]
    #: The written table (key, v) of corrections of bigrams above the classes' own discount, and what of it goes out with the tasks: all or nothing.
    bigrams: DataFrame
    strong: tuple[np.ndarray, np.ndarray] | None


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = rows.column("key").to_numpy().view(np.uint64), rows.column("v").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def train(scratch: Scratch, known: DataFrame) -> Models | None:
    """The models of known(text, label); None unless both classes have words."""
    slices = SLICES

    def counting(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: _count(batches, share, slices)

    shares = []
    for k in range(slices):
        counted = known.mapInArrow(counting(k), "context long, word long, n0 long, n1 long")
        counted = counted.groupBy("context", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        shares.append(scratch.keep(counted.sortWithinPartitions("context", "word"), f"pairs-{k}", **PACKED))
    pairs = reduce(DataFrame.unionByName, shares)
    words = scratch.keep(pairs.groupBy("word").agg(F.sum("n0").alias("u0"), F.sum("n1").alias("u1"), F.count(F.lit(1)).alias("t")), "words")
    n0, n1, t, n_words = words.agg(F.sum("u0"), F.sum("u1"), F.sum("t"), F.count(F.lit(1))).first()
    if not n0 or not n1:
        return None
    sizes, least = (n0, n1), min(n0, n1)
    own_discount, spread = OWN_DISCOUNT, DISCOUNT * n_words / t / (n_words + 1)
    rates = [(F.col(f"u{c}") + KAPPA) / ((F.col("u0") + F.col("u1")) * F.lit(sizes[c] / (n0 + n1)) + KAPPA) for c in (0, 1)]
    continuation = F.greatest(F.col("t") - DISCOUNT, F.lit(0.0)) / t + spread
    rated = words.select("word", (F.col("u0") + F.col("u1")).alias("n"), continuation.alias("p"), *[r.alias(f"r{c}") for c, r in enumerate(rates)])
    whole = [x + spread for x in rated.agg(*[F.sum(F.col("p") * F.col(f"r{c}")) for c in (0, 1)]).first()]

    both, scaled = F.col("n0") + F.col("n1"), [F.col(f"n{c}") * F.lit(least / sizes[c]) for c in (0, 1)]
    left = F.greatest(both - DISCOUNT, F.lit(0.0))
    sums = [F.sum(x).alias(k) for k, x in (("h", both), *[(f"z{c}", left * F.col(f"r{c}")) for c in (0, 1)], *[(f"q{c}", scaled[c]) for c in (0, 1)], *[(f"l{c}", F.least(scaled[c], F.lit(own_discount))) for c in (0, 1)])]
    back = F.lit(DISCOUNT) * F.col("t") / F.col("h")
    z = [F.col(f"z{c}") / F.col("h") + back * F.lit(whole[c]) for c in (0, 1)]
    own = [F.when(F.col(f"q{c}") > 0, F.col(f"l{c}") / F.col(f"q{c}")).otherwise(1.0) for c in (0, 1)]

    def of_contexts(pairs: DataFrame) -> DataFrame:
        met = pairs.join(broadcast_if_small(rated.select("word", "r0", "r1"), n_words), "word")
        sides = [x.alias(k) for k, x in zip(("z0", "z1", "o0", "o1"), (*z, *own), strict=True)]
        return met.groupBy("context").agg(F.count(F.lit(1)).alias("t"), *sums).select("context", "h", back.alias("back"), "q0", "q1", *sides)

    contexts = reduce(DataFrame.unionByName, [scratch.keep(of_contexts(share), f"contexts-{k}") for k, share in enumerate(shares)])

    f = F.log(F.col("r1") / F.col("r0"))
    g = F.log(F.col("o1") / F.col("o0")) - F.log(F.col("z1") / F.col("z0"))
    unseen = float(-np.log(whole[1] / whole[0]))
    table = rated.select(F.col("word").alias("key"), "n", f.alias("f")).join(contexts.select(F.col("context").alias("key"), g.alias("g")), "key", "full")
    table = scratch.keep(table.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("g", F.lit(unseen)).alias("g")), "model")
    edges = {r.key: r for r in table.where(F.col("key").isin(int(START), int(END))).collect()}
    by_word = table.where(~F.col("key").isin(int(START), int(END))).select("key", "n", (F.col("f") + F.col("g")).alias("v"))
    head = _sorted(by_word.where(F.col("n") >= max(1.0, FREQUENT * (n0 + n1))).select("key", "v").toArrow())

    above = scratch.keep(pairs.where((scaled[0] > own_discount) | (scaled[1] > own_discount)), "above")
    n_above = above.count()
    strong = rated.join(broadcast_if_small(above, n_above), "word").select("context", "word", "n0", "n1", "p", "r0", "r1")
    strong = contexts.join(broadcast_if_small(strong, n_above), "context")
    shared = left / F.col("h") + F.col("back") * F.col("p")
    likely = [F.when(F.col(f"q{c}") > 0, F.greatest(scaled[c] - own_discount, F.lit(0.0)) / F.col(f"q{c}")).otherwise(0.0) + F.col(f"o{c}") * shared * F.col(f"r{c}") / F.col(f"z{c}") for c in (0, 1)]
    bigrams = scratch.keep(strong.select(bigram_key("context", "word").alias("key"), (F.log(likely[1] / likely[0]) - f - g).alias("v")), "bigrams")
    scratch.drop(*[f"{name}-{k}" for name in ("pairs", "contexts") for k in range(slices)], "words", "above")
    return Models(by_word.select("key", "v"), edges[int(START)].g + edges[int(END)].f, unseen, head, bigrams, _sorted(bigrams.toArrow()) if n_above <= SENT_BIGRAMS else None)


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the table, and the values of those."""
    if not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(0)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    found = table[0][at] == keys
    return found, table[1][at[found]]


def ratios(scratch: Scratch, docs: DataFrame, models: Models) -> DataFrame:
    """docs' doc_id with llr, the mean log-likelihood ratio of a step, and usual, the median of the text's frequent words; null without words."""
    sent = docs.sparkSession.sparkContext.broadcast((models.head, models.strong))
    once = models.once

    @F.arrow_udf("n long, total double, usual double, others array<long>, steps array<long>")
    def looked_up(texts: pa.Array) -> pa.Array:
        head, strong = sent.value
        out: list[tuple] = []
        for text in texts:
            words = words_of(text)
            found, values = _looked_up(words, head)
            keys = bigram_keys(*steps_of(words)) if len(words) else np.zeros(0, np.uint64)
            corrections = _looked_up(keys, strong)[1] if strong is not None else np.zeros(0)
            out.append((len(words), once + values.sum() + corrections.sum(), np.median(values) if len(values) else 0.0, words[~found].view(np.int64), keys.view(np.int64) if strong is None else None))
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["n", "total", "usual", "others", "steps"])

    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", looked_up("text").alias("s"))
    scanned = scratch.keep(scanned.select("row", "doc_id", "s.*"), "scanned", **PACKED)

    def answered(asked: str, table: DataFrame, word: int, share: int) -> DataFrame:
        own = lambda key: F.pmod(key, F.lit(SLICES)) == share
        keys = scanned.select("row", F.explode(F.filter(asked, own)).alias("key"))
        return keys.join(table.where(own(F.col("key"))), "key").select("row", "v", F.lit(word).alias("word"))

    parts = []
    for k in range(SLICES):
        found = answered("others", models.words, 1, k)
        if models.strong is None:
            found = found.unionByName(answered("steps", models.bigrams, 0, k))
        parts.append(scratch.keep(found.groupBy("row").agg(F.sum("v").alias("more"), F.sum("word").alias("known")), f"answers-{k}"))
    answers = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("more").alias("more"), F.sum("known").alias("known"))
    joined = scanned.select("row", "doc_id", "n", "total", "usual", F.size("others").alias("asked")).join(answers, "row", "left")
    total = F.col("total") + F.coalesce("more", F.lit(0.0)) + F.lit(models.unseen) * (F.col("asked") - F.coalesce("known", F.lit(0)))
    return joined.select("doc_id", F.when(F.col("n") > 0, total / (F.col("n") + 1)).alias("llr"), "usual")


def calibrate(x: np.ndarray, y: np.ndarray):
    """A function from rows of x to the chance of label 1: a logistic fit chooses the direction, isotonic regression the heights."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)

    def placed(rows: np.ndarray) -> np.ndarray:
        return np.column_stack([(rows - mean) / sd, np.ones(len(rows))])

    z, b = placed(x), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(b)), z.T @ (y - p) - 1e-2 * b)
        b += np.clip(step, -5, 5)
    knots, values = isotonic(z @ b, y)
    return lambda rows: np.clip(np.interp(placed(rows) @ b, knots, values), 0, 1)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, llr, usual: one row per row of docs.

    Labels are learned from rows whose crc32(doc_id) modulo 3 is not 1. A text without words (null, empty, blank) gets
    the share of label 1 among the labelled, as does every text when the labels counted, or those that calibrate, do not
    hold both kinds (0.5 without any). A null doc_id counts as fold 0; a doc_id that repeats in labels counts once, with
    its larger label. Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(fold("doc_id", FOLDS) != HELD_OUT)
    known = scratch.keep(known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("calibrates", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(CALIBRATES)) == 0, F.lit(False))), "known")
    rows, share = known.agg(F.count(F.lit(1)), F.avg("label")).first()
    base = 0.5 if share is None else float(share)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    models = train(scratch, own.join(broadcast_if_small(known.where("not calibrates").drop("calibrates"), rows), "doc_id").select("text", "label"))
    found, calibrated = None, None
    if models is not None:
        found = scratch.keep(ratios(scratch, own, models), "ratios")
        scratch.drop("scanned", *[f"answers-{k}" for k in range(SLICES)], "model", "bigrams")
        cut = int(1_000_000 * min(1.0, CALIBRATION_ROWS * CALIBRATES / max(1, rows)))
        held = known.where("calibrates").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < cut).drop("calibrates")
        seen = found.join(F.broadcast(held), "doc_id").where("llr is not null").select("llr", "usual", "label").toArrow()
        x, y = np.column_stack([seen.column(c).to_numpy() for c in ("llr", "usual")]), seen.column("label").to_numpy().astype(float)
        calibrated = calibrate(x, y) if 0 < y.sum() < len(y) else None
    if calibrated is None:
        scored = (own if found is None else found).select("doc_id", F.lit(base).alias("score"), *([F.lit(None).cast("double").alias(c) for c in ("llr", "usual")] if found is None else ["llr", "usual"]))
    else:

        @F.arrow_udf("double")
        def score(llr: pa.Array, usual: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in (llr, usual)])
            return pa.array(np.where(np.isnan(x[:, 0]), base, calibrated(np.nan_to_num(x))), pa.float64())

        scored = found.select("doc_id", score("llr", "usual").alias("score"), "llr", "usual")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "llr", "usual")
