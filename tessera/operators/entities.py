"""Clean-up of an entity table: junk, merges by key, surnames, and the edges that point to what was merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def merge_plan(entities: DataFrame, places: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(drops: id, name, reason), (merges: from_id, into_id, reason) of entities (id, name, kind, claims).

    Of the names with one key the one with most claims stays (ties: plain ASCII, then the smaller id). A person of one word goes
    into the only person with that surname. Chains need one more hop at most: a surname's target may itself be merged by key.
    """
    rows = entities.withColumn("reason", names.junk_reason(F.col("name"), F.col("kind"), places or []))
    drops = rows.where("reason is not null").select("id", "name", "reason")
    kept = rows.where("reason is null").drop("reason").withColumn("key", names.key(F.col("name"))).where("key <> ''")
    ascii_first = F.col("name").rlike(r"^[\x20-\x7e]+$").cast("int")
    best = kept.groupBy("key").agg(F.max_by("id", F.struct("claims", ascii_first, -F.col("id"))).alias("into_id"))
    by_key = kept.join(best, "key")
    merged = by_key.where("id <> into_id").select(F.col("id").alias("from_id"), "into_id", F.lit("same key").alias("reason"))
    people = by_key.where("kind = 'person' and id = into_id").select("id", "key")
    full = people.where(F.col("key").contains(" ")).select(F.col("id").alias("full_id"), F.element_at(F.split("key", " "), -1).alias("surname"))
    only = full.groupBy("surname").agg(F.min("full_id").alias("full_id"), F.count("*").alias("n")).where("n = 1")
    bare = people.where(~F.col("key").contains(" ")).join(only, F.col("key") == F.col("surname"))
    surnames = bare.select(F.col("id").alias("from_id"), F.col("full_id").alias("into_id"), F.lit("only full name").alias("reason"))
    # a name merged by key into a bare surname goes on to where the surname goes
    hop = surnames.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("next"))
    merges = merged.join(hop, "into_id", "left").select("from_id", F.coalesce("next", "into_id").alias("into_id"), "reason").unionByName(surnames)
    return drops, merges


def representative_names(names_by_key: DataFrame) -> DataFrame:
    """Per key the shortest spelling (ties: the first in order) of a table (key, name)."""
    w = Window.partitionBy("key").orderBy(F.length("name"), "name")
    return names_by_key.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", "name")
