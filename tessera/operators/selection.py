"""Selections whose shape is given at run time: filters that may be absent, columns by role, windows, ladders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The rows for which all conditions hold that are given."""
    return reduce(DataFrame.filter, [c for c in conditions if c is not None], df)


def equals(column: str, value) -> Column | None:
    """column = value, or nothing where there is no value."""
    return None if value is None else F.col(column) == value


def contains(column: str, part: str | None) -> Column | None:
    return F.col(column).ilike(f"%{part}%") if part else None


def in_window(column: str, first: str | None, last: str | None) -> Column | None:
    """Dates from first to last, both included and each optional. Undated rows are out where there is a window."""
    ends = ([F.col(column) >= F.lit(first).cast("date")] if first else []) + ([F.col(column) <= F.lit(last).cast("date")] if last else [])
    return reduce(Column.__and__, ends) if ends else None


def on_day(time: Column, day: Column, start: Column, end: Column, on: Column) -> Column:
    """Whether a row is in a rolling window by its time; rows without one by their day."""
    return F.coalesce((time >= start) & (time < end), day == on, F.lit(False))


def visible(df: DataFrame, withheld: Sequence[str], member: bool) -> DataFrame:
    """df without the columns that only members see: what isn't selected isn't computed."""
    return df if member else df.drop(*withheld)


def exists(df: DataFrame, name: str) -> DataFrame:
    """One row: whether df has any. One row is looked for, not all."""
    return df.limit(1).agg((F.count("*") > 0).alias(name))


def ladder(n: int, rungs: Sequence[int] = (50, 25)) -> list[int]:
    """Sizes of a batch to try: all of it, then each smaller rung."""
    return reduce(lambda sizes, r: [*sizes, r] if r < sizes[-1] else sizes, rungs, [n])


def evidence_order(mode: str, published: str, reliability: str, seen: str, label: str, key: str) -> list[Column]:
    """How evidence is sorted: by a mode, nulls last in all of them, then by first seen, label and key."""
    first = {
        "oldest_published": [F.asc_nulls_last(published)],
        "newest_published": [F.desc_nulls_last(published)],
        "reliability": [F.desc_nulls_last(reliability)],
        "label": [F.lower(label).asc_nulls_last()],
    }[mode]
    return [*first, F.asc_nulls_last(seen), F.lower(label).asc_nulls_last(), F.col(key)]
