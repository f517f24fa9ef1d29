"""How queries are put together: one column or a few of every row of a table, and its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pageloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, without a leading underscore."""

    def add(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def column(name: str, of: str, key: str, value: Callable[[], Column | dict[str, Column] | tuple], sql: str, source: str | None = None) -> None:
    """Registers (key, value) of every row of a table; ``sql`` is the value's expression, or several with names.

    A value is a column, several with names, or one that is computed once with what is selected of it as ``v``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = value()
        if isinstance(made, tuple):
            return read(spark, sf_dir, of).select(key, made[0].alias("v")).selectExpr(key, *made[1:])
        return read(spark, sf_dir, of).select(key, *((c.alias(n) for n, c in made.items()) if isinstance(made, dict) else [made.alias("value")]))

    QUERIES[name] = run
    named = re.search(r" AS [a-z_]+$", sql)
    ORACLE_SQL[name] = f"SELECT {key}, {sql if named else f'{sql} AS value'} FROM {source or of}"
