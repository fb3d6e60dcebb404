"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from phonolith.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, engine, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    said = engine.execute(SQL[name])
    assert got == rows_of([d[0] for d in said.description], said.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_known_without_a_session():
    """The registry is read before any session exists."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"], cwd=root, capture_output=True, text=True)
    assert said.stdout.strip().endswith("True"), said.stderr[-500:]
