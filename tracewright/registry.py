"""Registration of named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of `Tables`; `sql` gives the same rows in DuckDB."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def both(name: str, sql: str) -> None:
    """A query whose text means the same in Spark SQL and DuckDB."""
    query(name, sql)(lambda t: t.sql(sql))


def expressions(name: str, table: str, key: str, rows: list[tuple[str, str] | tuple[str, str, str]], where: str = "true") -> None:
    """One wide projection: (alias, Spark expression[, DuckDB expression]) over a table, with its key."""
    spark = [f"{r[1]} AS {r[0]}" for r in rows]
    duck = ", ".join(f"{r[-1]} AS {r[0]}" for r in rows)
    query(name, f"SELECT {key}, {duck} FROM {table} WHERE {where}")(lambda t: t[table].where(where).selectExpr(key, *spark))
