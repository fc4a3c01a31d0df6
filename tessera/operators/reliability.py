"""How reliable sources are, from how what they said was hedged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_weight(weight: Column) -> Column:
    """The mean of integer hundredths, to four places."""
    n = F.count("*")
    return F.floor((F.sum(weight.cast("bigint")) * 200 + n) / (n * 2)).cast("double") / 10000


def source_reliability(citations: DataFrame, keys: list[str], kind: str, date: str, weight: Column, decay_months: int = 12) -> DataFrame:
    """For each source: citations, the weighted mean of its classes, first and last date, and whether it has gone quiet.

    weight is in hundredths, so that the mean is exact to its fourth place, rounded half up, whatever the order of rows.
    Quiet is: not cited in the months before the corpus's last date. That date is an aggregate of the same table, one row.
    """
    corpus = citations.agg(F.max(date).alias("corpus_last"))
    each = citations.groupBy(*keys).agg(
        F.count("*").alias("citations"),
        mean_weight(weight).alias("reliability"),
        F.count_if(F.col(kind).isNull()).alias("unclassified"),
        F.min(date).alias("first_cited"),
        F.max(date).alias("last_cited"),
    )
    return each.join(F.broadcast(corpus)).withColumn("decayed", F.col("last_cited") < F.add_months("corpus_last", -decay_months)).drop("corpus_last")
