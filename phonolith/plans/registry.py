"""Names of the library's queries, what they run and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phonolith.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str = "", sql: str | None = None):
    """Registers a function of one derived table (or, without a text, of spark and the folder).

    In sql, {t} stands for the derived table.
    """

    def register(f):
        QUERIES[name] = (lambda spark, d: f(fx.derived(spark, d, table))) if table else f
        if sql is not None:
            SQL[name] = sql.replace("{t}", f"({fx.plain(table)})") if table else sql
        return f

    return register
