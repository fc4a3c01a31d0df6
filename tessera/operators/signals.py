"""Detectors over claims and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

#: Roles of those under pressure; roles for which the text decides, and what it says then.
PRESSURE_ROLES, OPEN_ROLES = ("defendant", "dismissed", "accused", "suspect"), ("target", "subject", "other")
PRESSURE = (
    r"(?i)\b(arrest\w*|detain\w*|detention|charg(?:ed|es)|indict\w*|prosecut\w*|convict\w*|sentenc\w*|criminal case|treason case|investigat\w*|under investigation|dismiss\w*|"
    r"removed from (?:office|post|command)|relieved of (?:duty|command|post)|ousted|suspended from|sanction\w*|asset (?:seizure|freeze)|confiscat\w*)\b"
)


def is_pressure(kind: Column, role: Column, text: Column) -> Column:
    return (kind == "person") & (role.isin(*PRESSURE_ROLES) | (role.isin(*OPEN_ROLES) & text.rlike(PRESSURE)))


def purges(claims: DataFrame, theater: str, person: str, kind: str, role: str, text: str, claim: str, date: str, as_of: Column, days: int, least: int = 3) -> DataFrame:
    """Theaters where enough different persons, whatever the spelling, are under pressure in the window; elevated from twice as many on."""
    recent = claims.where((F.col(date) >= F.date_sub(as_of, days)) & is_pressure(F.col(kind), F.col(role), F.col(text)))
    found = recent.groupBy(theater).agg(F.count_distinct(names.key(F.col(person))).alias("persons"), F.count_distinct(claim).alias("claims")).where(F.col("persons") >= least)
    return found.withColumn("severity", F.when(F.col("persons") >= 2 * least, "elevated").otherwise("watch"))


def dark_series(series: DataFrame, least: int = 1) -> DataFrame:
    """Per theater the series that went dark (classified, gone or stale); elevated if one of them changed recently."""
    dark = series.where(F.col("status").isin("classified", "gone", "stale"))
    found = dark.groupBy("theater").agg(F.count("*").alias("dark"), F.bool_or("changed_recently").alias("recent")).where(F.col("dark") >= least)
    return found.withColumn("severity", F.when(F.col("recent"), "elevated").otherwise("watch"))


def ranked(signals: DataFrame) -> DataFrame:
    """Elevated ones first, then by kind and key."""
    return signals.orderBy(F.when(F.col("severity") == "elevated", 0).otherwise(1), "kind", "key")


def trade_signals(divergences: DataFrame, goods: str, all_goods: str, many: int = 5) -> DataFrame:
    """One signal where flows of certain goods are flagged (not of all goods together): kind, key, n, severity; elevated from `many` flows on."""
    flows = divergences.where(F.col("flagged") & (F.col(goods) != all_goods)).agg(F.count("*").alias("n")).where("n > 0")
    return flows.select(F.lit("trade_divergence").alias("kind"), F.lit("trade_divergence:ru").alias("key"), "n", F.when(F.col("n") >= many, "elevated").otherwise("watch").alias("severity"))
