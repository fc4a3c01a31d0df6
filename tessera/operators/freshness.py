"""When a watched series counts as fresh."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first letters of Russian months.
MONTHS = ("янв", "фев", "мар", "апр", "ма", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def period_start(label: Column) -> Column:
    """First day of what a label names: dd.mm.yyyy, a Russian month and year, or a year; null for others and impossible dates."""
    s = F.lower(F.trim(label))
    year = F.regexp_extract(s, r"(20\d\d)$", 1)
    month = F.lit(None).cast("string")
    for i, stem in sorted(enumerate(MONTHS, 1), key=lambda m: len(m[1])):
        month = F.when(F.regexp_extract(s, r"^([а-яё]+)\s+20\d\d$", 1).startswith(stem), F.lit(f"{i:02d}")).otherwise(month)
    return (
        F.when(s.rlike(r"^\d{2}\.\d{2}\.20\d\d$"), F.try_to_date(s, "dd.MM.yyyy"))
        .when(s.rlike(r"^[а-яё]+\s+20\d\d$"), F.try_to_date(F.concat(year, F.lit("-"), month, F.lit("-01"))))
        .when(s.rlike(r"^20\d\d$"), F.try_to_date(F.concat(s, F.lit("-01-01"))))
    )


def period_end(label: Column) -> Column:
    """The day after the last one that a label names."""
    s, start = F.lower(F.trim(label)), period_start(label)
    return F.when(s.rlike(r"^\d{2}\.\d{2}\."), F.date_add(start, 1)).when(s.rlike(r"^20\d\d$"), F.add_months(start, 12)).otherwise(F.add_months(start, 1))


def latest_period(page: Column, pattern: str) -> Column:
    """The label on a page, of all that match the pattern (its first group, or all of it), that names the latest period; the first one where
    none can be read."""
    group = F.lit(1 if re.compile(pattern).groups else 0)
    labels = F.transform(F.regexp_extract_all(page, F.lit(f"(?iu){pattern}"), group), lambda x: F.trim(x))
    named = F.filter(F.transform(labels, lambda x, i: F.struct(period_start(x).alias("start"), (-i).alias("i"), x.alias("label"))), lambda x: x.getField("start").isNotNull())
    return F.coalesce(F.array_max(named).getField("label"), F.get(F.filter(labels, lambda x: x != ""), 0))


def series_status(http: Column, size: Column, period: Column, previous: Column, baseline: Column, cadence: Column, unchanged_days: Column, as_of: Column) -> Column:
    """classified, unreachable, gone, stale or ok: the first rule that holds."""
    parsed, stored = period_start(period), period_start(previous)
    older = F.coalesce(parsed < stored, F.lit(False))
    judged = F.when(older, previous).otherwise(period)
    age = F.datediff(as_of, period_end(judged))
    late = F.when(parsed.isNotNull(), age > cadence * 2).otherwise((period == previous) & (unchanged_days > cadence * 2))
    return (
        F.when((baseline == "classified") & ~F.coalesce((http == 200) & period.isNotNull(), F.lit(False)), "classified")
        .when(http.isNull(), "unreachable")
        .when((http == 404) | ((http == 200) & (size < 500)), "gone")
        .when(http >= 400, "unreachable")
        .when(period.isNull(), "ok")
        .when(F.coalesce(late, F.lit(False)), "stale")
        .otherwise("ok")
    )


def cadence_status(events: DataFrame, keys: list[str], at: str, as_of: Column, cadence_days: Column) -> DataFrame:
    """Per series: when it last moved, its age in days, and stale if that is over twice its cadence."""
    last = events.groupBy(*keys).agg(F.max(F.to_date(at)).alias("last"))
    age = F.datediff(as_of, "last")
    return last.withColumn("age_days", age).withColumn("status", F.when(age > cadence_days * 2, "stale").otherwise("ok"))
