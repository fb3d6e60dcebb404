"""Language identification by multilingual mixture inference.

Each language is a distribution over character trigrams, counted over all training documents. A document is a mixture:
expectation-maximisation estimates its language proportions, and the set of languages is the one with the best
likelihood after a penalty of ln(n) / 2 for each proportion. The predicted language is the one with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import fold, mix

FOLDS, HELD_OUT = 5, 0
#: Trigrams are counted in so many hashed cells per language ...
CELLS = 1 << 16
#: ... or, for more than 256 languages, in so many fewer that the model has at most this number of cells.
ALL_CELLS = 1 << 24
SMOOTH = 0.5
#: Expectation-maximisation goes on until no share changes by more than this.
STILL = 1e-4
#: Languages with less than this share after the first inference are not tried in a set.
LEAST_SHARE = 0.02
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray:
    """Cells of the trigrams of letters; a run of anything else is one space. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.where(is_letter, points, np.uint32(32))
    points = np.concatenate([[32], points, [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])].astype(np.uint64)
    packed = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:] if len(points) > 2 else points[:0]
    return (mix(packed) & np.uint64(CELLS - 1)).astype(np.int64)


def infer(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages in a document and its log-likelihood; rows: likelihoods of its trigrams by language."""
    share = np.full(rows.shape[1], 1 / rows.shape[1])
    n = counts.sum()
    while True:
        new = share * ((counts / (rows @ share)) @ rows) / n
        change, share = np.abs(new - share).max(), new
        if change <= STILL:
            return share, float(counts @ np.log(rows @ share))


def languages_of(cells: np.ndarray, likely: np.ndarray) -> dict[int, float]:
    """Shares of the chosen set of languages, by column of likely (cells x languages).

    Languages with a share worth trying are added one at a time, each time the one that raises the likelihood most, as
    long as it rises by more than the penalty.
    """
    cells, counts = np.unique(cells, return_counts=True)
    rows, counts = likely[cells].astype(float), counts.astype(float)
    share, _ = infer(rows, counts)
    left = [int(k) for k in np.argsort(-share, kind="stable") if share[k] >= LEAST_SHARE] or [int(np.argmax(share))]
    penalty = 0.5 * np.log(counts.sum())
    chosen, found, best = [], None, -np.inf
    while left:
        tried = [(infer(rows[:, [*chosen, k]], counts), k) for k in left]
        (shares, gain), k = max(tried, key=lambda x: x[0][1])
        if chosen and gain - penalty <= best:
            break
        chosen.append(k)
        left.remove(k)
        found, best = shares, gain
    return dict(zip(chosen, map(float, found), strict=True))


def train(own: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the table of trigram probabilities (cells x languages) of own(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                total = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                cells, times = np.unique(trigrams(text.as_py()), return_counts=True)
                total[cells] += times
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": at.astype(np.int32), "n": total[at]})

    def packed(rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        total[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    summed = own.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = {r.lang: bytes(r.counts) for r in summed.groupBy("lang").applyInArrow(packed, "lang string, counts binary").toLocalIterator()}
    names = sorted(found)
    cells = min(CELLS, 1 << int(np.log2(ALL_CELLS / max(1, len(names)))))
    table = np.empty((cells, len(names)), np.float32)
    for i, name in enumerate(names):
        total = np.frombuffer(found.pop(name), np.int64).reshape(-1, cells).sum(axis=0) + SMOOTH
        table[:, i] = total / total.sum()
    return names, table


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: one row per row of docs.

    Learned from documents with a lang whose crc32(doc_id) modulo 5 is not 0. score is the predicted language's share;
    mixture lists the chosen set as lang:share. A text that is null or has no letter, or any text when nothing could be
    learned, is 'und' with score 0. Ties go to the language first in code-point order. A null doc_id counts as fold 0,
    so it is held out. Repeated rows count as often as they stand; an empty table gives an empty result; other columns
    are ignored.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    names, table = train(known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    model = spark.sparkContext.broadcast((names, table))  # at most ALL_CELLS numbers of 4 bytes

    @F.arrow_udf("lang_pred string, score double, mixture string")
    def said(texts: pa.Array) -> pa.Array:
        names, table = model.value
        rows = []
        for text in texts:
            cells = trigrams(text.as_py()) & (len(table) - 1) if names else ()
            shares = languages_of(cells, table) if len(cells) else {}
            top = min(shares, key=lambda k: (-shares[k], k), default=None)
            mixture = ",".join(f"{names[k]}:{s:.3f}" for k, s in sorted(shares.items(), key=lambda x: (-x[1], x[0])))
            rows.append(("und", 0.0, "") if top is None else (names[top], min(1.0, shares[top]), mixture))
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "mixture": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), said(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "mixture")
