"""A training-text pipeline over documents; counted with the llm subpackage.

Each stage reads what its predecessor kept, as written Parquet, and calls one operator. Quality rejects documents whose
predicted quality is 0; exact and near deduplication keep one document of each group; decontamination drops documents
that hold a benchmark item; the last stage gives each remaining document its part in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonolith.llm.common import Scratch, table
from phonolith.llm.decontaminate import decontaminate
from phonolith.llm.exact_dedup import keep_first
from phonolith.llm.mixing import mix
from phonolith.llm.near_dedup import keep_one
from phonolith.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(spark, docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words the mix takes; 0: the mix leaves it out), source."""
    return mix(spark, docs)[0]


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
]

#: The quality classifier has no SQL form; a test holds the other stages against brute force on its output.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for documents; the other stages' results are written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
