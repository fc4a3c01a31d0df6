"""Every query over the driver tables, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) -> DataFrame under a name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def picked(items: list, number: Column) -> Column:
    """The item of a row, in turns by its number."""
    return F.get(F.array(*[F.lit(x) for x in items]), F.pmod(number, F.lit(len(items))).cast("int"))


def picked_sql(items: list, number: str) -> str:
    named = ", ".join("NULL" if x is None else f"{x}" if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in items)
    return f"[{named}][CAST(1 + ({number}) % {len(items)} AS BIGINT)]"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
