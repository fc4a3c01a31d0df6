"""Calendar days in UTC and in the zone that readers see, states of a day's digest, and times of schedules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of "today".
ZONE = "America/New_York"


def utc_day(at: Column) -> Column:
    return F.to_date(at.cast("timestamp_ntz"))


def shown_day(at: Column, zone: str = ZONE) -> Column:
    """The calendar day of a UTC instant in the readers' zone, with its summer time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")))


def day_range(first: Column, last: Column) -> Column:
    """All days from first to last; none if they are the wrong way round or not dates."""
    some = first.isNotNull() & last.isNotNull() & (first <= last)
    return F.when(some, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<date>"))


def stage(day: Column, written_at: Column) -> Column:
    """final if a day's digest was last written on a later UTC day, else intraday."""
    return F.when(utc_day(written_at) > day, "final").otherwise("intraday")


def status(day: Column, now: Column) -> Column:
    """Whether a digest is today's (the readers' today, or later), one of a day before, or none."""
    return F.when(day.isNull(), "none").when(day >= shown_day(now), "today").otherwise("previous")


def next_fire(now: datetime, schedules: Iterable[str]) -> datetime:
    """The first time after now, in UTC, of daily schedules "minute hour * * *"; others are left out."""
    times = []
    for s in schedules:
        found = re.fullmatch(r"(\d{1,2})\s+(\d{1,2})\s+\*\s+\*\s+\*", s.strip())
        if found and int(found[1]) < 60 and int(found[2]) < 24:
            today = now.replace(hour=int(found[2]), minute=int(found[1]), second=0, microsecond=0)
            times.append(today if today > now else today + timedelta(days=1))
    if not times:
        raise ValueError("no daily schedule")
    return min(times)
