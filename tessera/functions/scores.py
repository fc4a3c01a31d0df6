"""Scores and decays as column expressions. `as_of` is always given: results don't hang on the clock."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a candidate without a vector score counts as; days and hours of half-lives; what undated rows count as.
LEXICAL_ONLY = 0.55
CLAIM_HALF_LIFE_DAYS, UNDATED_DECAY = 30, 0.25
GROUP_HALF_LIFE_HOURS, UNDATED_RECENCY = 48, 0.5
#: A source without a reliability.
UNKNOWN_RELIABILITY = 0.3
#: Weights of a claim pair's texts, entities and hints.
PAIR_WEIGHTS = (0.6, 0.25, 0.15)


def reliability(r: Column) -> Column:
    return F.coalesce(r, F.lit(UNKNOWN_RELIABILITY))


def composite(vector: Column, date: Column, confidence: Column, as_of: Column, lexical_only: bool = False) -> Column:
    """Semantic score x recency x reliability."""
    semantic = F.lit(1.0) if lexical_only else F.coalesce(vector, F.lit(LEXICAL_ONLY))
    age = F.greatest(F.datediff(as_of, date), F.lit(0))  # greatest() skips nulls: undated rows need their own case
    decay = F.when(date.isNull(), F.lit(UNDATED_DECAY)).otherwise(F.pow(F.lit(0.5), age / CLAIM_HALF_LIFE_DAYS))
    return semantic * decay * (F.lit(0.5) + F.lit(0.5) * F.coalesce(confidence, F.lit(0.5)))


def age_hours(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9


def group_score(independent: Column, reliability: Column, size: Column, latest: Column, as_of: Column) -> Column:
    """How much a group of claims is worth: corroboration, reliability, size, recency."""
    age = F.greatest(age_hours(latest, as_of), F.lit(0.0))
    recency = F.when(latest.isNull(), F.lit(UNDATED_RECENCY)).otherwise(F.exp(age * (-math.log(2) / GROUP_HALF_LIFE_HOURS)))
    return (1 + F.log1p(independent)) * (F.lit(0.3) + reliability) * (1 + F.log1p(size)) * (F.lit(0.4) + F.lit(0.6) * recency)


def profile_score(track: Column, kind: Column, platform: Column, n: Column, confidence: Column, latest: Column, as_of: Column, half_life: float) -> Column:
    """An event's score for a reader: weights of its track, kind and best platform, corroboration, confidence, recency."""
    age = age_hours(latest, as_of)
    recency = F.when(latest.isNull(), F.lit(0.5)).when(age < 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / half_life))
    return track * kind * platform * (1 + F.log1p(n)) * (F.lit(0.5) + F.coalesce(confidence, F.lit(0.4))) * (F.lit(0.4) + F.lit(0.6) * recency)


def risk(hhi: Column, exposed_pct: Column) -> Column:
    return F.round(F.lit(0.5) * F.least(F.lit(1.0), hhi / 0.6) + F.lit(0.5) * exposed_pct / 100, 3)


def backoff_hours(failures: Column) -> Column:
    """1, 2, 4 ... hours, at most 48."""
    return F.least(F.lit(48.0), F.pow(F.lit(2.0), failures - 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
