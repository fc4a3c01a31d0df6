"""Several runs of one analysis, merged by majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, let

#: How much of two events' ids must be shared for them to be one event; events that a merge gives at most.
SHARED, MOST = 0.5, 12


def _clusters(events: Column) -> Column:
    """The cluster of each event (an array of ids) in their order: the one whose ids so far it shares most of (ties: the earlier), SHARED at least, else a new one."""
    start = F.struct(F.array().cast("array<array<bigint>>").alias("held"), F.array().cast("array<int>").alias("of"))

    def step(state: Column, ids: Column) -> Column:
        held = state.getField("held")
        best = F.array_max(F.transform(held, lambda c, i: F.struct(jaccard(ids, c).alias("share"), (-i).alias("back"))))

        def put(best: Column) -> Column:
            joins = F.coalesce(best.getField("share") >= SHARED, F.lit(False))
            at = F.when(joins, -best.getField("back")).otherwise(F.size(held))
            grown = F.transform(held, lambda c, i: F.when(i == at, F.array_union(c, ids)).otherwise(c))
            return F.struct(F.when(joins, grown).otherwise(F.concat(held, F.array(ids))).alias("held"), F.concat(state.getField("of"), F.array(at)).alias("of"))

        return let(best, put)

    return F.aggregate(events, start, step, lambda s: s.getField("of"))


def merged_votes(votes: DataFrame, cell: str, runs: DataFrame) -> DataFrame:
    """cell, place, title, kind, votes, mean_rank, claims, ids: the events that over half of a cell's runs have.

    votes has cell, vote, place, title, kind and claims (structs of text and ids); runs has cell and runs, as a run without events counts too.
    Of an event, ids are those that over half of the runs put there; title and claims come from its middle one by the length of claims (ties: vote, place), without
    ids and claims that lack a majority; the kind is the most frequent one (ties: the middle's, then by name). Events whose middle keeps no claim go.
    Order: mean place, more votes, smallest id; MOST at most. A cell is one digest, a few runs of a few events, so its events are one row for their clusters. Null claims are none.
    """
    none = F.array().cast("array<struct<text: string, ids: array<bigint>>>")
    rows = votes.select(cell, "vote", F.col("place").alias("rank"), "title", "kind", F.coalesce("claims", none).alias("claims"))
    rows = rows.withColumn("ids", F.array_sort(F.array_distinct(F.flatten(F.transform("claims", lambda c: c.getField("ids"))))))
    events = F.array_sort(F.collect_list(F.struct("vote", "rank", "title", "kind", "claims", "ids"))).alias("events")
    numbered = rows.groupBy(cell).agg(events).withColumn("of", _clusters(F.transform("events", lambda e: e.getField("ids"))))
    each = numbered.select(cell, F.explode(F.arrays_zip("events", "of")).alias("x")).select(cell, F.col("x.of").alias("cluster"), "x.events.*")
    each = each.join(runs.select(cell, (F.floor(F.col("runs") / 2) + 1).alias("needed")), cell)
    on, size = [cell, "cluster"], F.aggregate("claims", F.lit(0), lambda n, c: n + F.length(c.getField("text")))
    by_size = Window.partitionBy(*on).orderBy("size", "vote", "rank")
    placed = each.withColumn("size", size).withColumn("at", F.row_number().over(by_size)).withColumn("n", F.count("*").over(Window.partitionBy(*on)))
    middle = placed.where(F.col("at") == F.floor((F.col("n") - 1) / 2) + 1).select(*on, "title", "claims", F.col("kind").alias("own_kind"))
    about = each.groupBy(*on, "needed").agg(F.countDistinct("vote").alias("votes"), F.avg("rank").alias("mean_rank")).where("votes >= needed")
    held = each.select(*on, "vote", "needed", F.explode("ids").alias("id")).groupBy(*on, "needed", "id").agg(F.countDistinct("vote").alias("v")).where("v >= needed")
    ids = held.groupBy(*on).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kinds = each.groupBy(*on, "kind").count().join(middle.select(*on, "own_kind"), on)
    kind = kinds.groupBy(*on).agg(F.min_by("kind", F.struct(-F.col("count"), F.col("kind") != F.col("own_kind"), "kind")).alias("kind"))
    joined = about.join(ids, on).join(middle, on).join(kind, on)
    cut = F.transform("claims", lambda c: F.struct(c.getField("text").alias("text"), F.filter(c.getField("ids"), lambda i: F.array_contains("ids", i)).alias("ids")))
    joined = joined.withColumn("claims", F.filter(cut, lambda c: F.size(c.getField("ids")) > 0)).where(F.size("claims") > 0)
    order = Window.partitionBy(cell).orderBy("mean_rank", F.desc("votes"), F.col("ids")[0])
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST).select(cell, "place", "title", "kind", "votes", "mean_rank", "claims", "ids")
