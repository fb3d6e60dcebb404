"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, token and shingle hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast, by its counted rows.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only where all tasks run in this process."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = tempfile.mkdtemp(prefix="spark-")
    return shared_dir.local


class Scratch:
    """Written tables that cut lineage: a lost executor costs a task, not the whole job.

    What a result may still read stays until the driver's process ends; drop() takes tables away before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        gc.collect()  # shuffle files of what is written now go as soon as the driver's JVM finds their plan unused
        self.spark._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hints a broadcast only for a counted side of at most BROADCAST_BYTES; else Spark shuffles the join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


# Token and shingle hashes for operators that work in Python. All of them see UTF-8 bytes, so only A-Z is folded.

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE = np.where(_IS_SPACE, np.uint64(0), _BYTE)
_KEEP = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_STRIPPED = np.where(_KEEP, _BYTE, np.uint64(0))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT_POWERS = 1 << 12
_BLOCK = 1 << 20


def _powers(n: int) -> np.ndarray:
    """Powers of the odd base modulo 2**64, at least n of them; only a short table is kept between texts."""
    if n > _KEPT_POWERS:
        return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]).cumprod(dtype=np.uint64)
    if not len(_kept):
        _kept.append(np.concatenate([np.ones(1, np.uint64), np.full(_KEPT_POWERS - 1, _BASE)]).cumprod(dtype=np.uint64))
    return _kept[0]


_kept: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(text: str | pa.Scalar | None) -> np.ndarray:
    """The bytes of a text; those of an Arrow value are not copied."""
    if isinstance(text, pa.Scalar):
        text = text.as_buffer()
    elif isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)


def word_hashes(text: str | pa.Scalar | None, strip: bool = False) -> np.ndarray:
    """A 64-bit hash per word, A-Z lower-cased. strip: other than letters, digits and non-ASCII bytes are left out of a word's hash.

    Long texts are worked off in blocks that end with a word, so what is held besides the hashes does not grow with them.
    """
    data, found, start = utf8(text), [np.zeros(0, np.uint64)], 0
    while start < len(data):
        end = start + _BLOCK
        while end < len(data) and not _IS_SPACE[data[end]]:
            gap = np.flatnonzero(_IS_SPACE[data[end : end + _BLOCK]])
            end += int(gap[0]) if len(gap) else _BLOCK
        found.append(_hashes(_LOWER[data[start:end]], strip))
        start = end
    return np.concatenate(found)


def _hashes(data: np.ndarray, strip: bool) -> np.ndarray:
    gap = _IS_SPACE[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not gap[0]:
        starts = np.append(0, starts)
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, starts = data[starts[0] :], starts - starts[0]
    sizes = np.diff(np.append(starts, len(data)))  # a word and the gap after it, whose values are 0
    if strip:
        keep = _KEEP[data]
        place = np.cumsum(keep, dtype=np.int32) - keep
        place -= np.repeat(place[starts], sizes)
        values = _STRIPPED[data]
    else:
        place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        values = _VALUE[data]
    return mix(np.add.reduceat(values * _powers(int(sizes.max())).take(place), starts))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    h = np.full(last, np.uint64(n))
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + last]
    return mix(h)


def shingle_set(text: str | pa.Scalar | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; the whole sequence as one if it is shorter; empty without words."""
    words = word_hashes(text)
    return np.unique(ngram_hashes(words, n if len(words) >= n else max(1, len(words))))
