"""How alike repeated runs of one analysis are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reproducibility(claims: DataFrame, cell: list[str], run: str, tokens: str, least: float = 0.5) -> DataFrame:
    """cell, pairs and reproducibility: over the ordered pairs of a cell's runs, the mean share of the first run's different claims of
    which the second has one of a Jaccard similarity of at least this. tokens: sorted distinct tokens of a claim; claims without any are left out.

    Claims meet over a shared token; of those with the similarity, some shared token is among the first ones of a claim.
    """
    own = claims.where(F.size(tokens) > 0).select(*cell, run, F.col(tokens).alias("s")).distinct()
    sizes = own.groupBy(*cell, run).agg(F.count("*").alias("n"))
    runs = sizes.groupBy(*cell).agg(F.count("*").alias("runs")).where("runs > 1")
    first = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * least).cast("int") + 1)
    side = lambda name: own.select(*cell, F.col(run).alias(f"{name}_run"), F.col("s").alias(name), F.explode(first).alias("t"))
    met = side("x").join(side("y"), [*cell, "t"]).where("x_run <> y_run").select(*cell, "x_run", "y_run", "x", "y").distinct()
    shared = F.size(F.array_intersect("x", "y"))
    hits = met.where(shared >= least * (F.size("x") + F.size("y") - shared)).groupBy(*cell, "x_run", "y_run").agg(F.count_distinct("x").alias("hit"))
    by_run = hits.groupBy(*cell, F.col("x_run").alias(run)).agg(F.sum("hit").alias("hit"))
    share = sizes.join(runs, cell).join(by_run, [*cell, run], "left").select(*cell, "runs", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("share"))
    # each run is the first of runs - 1 pairs
    return share.groupBy(*cell, "runs").agg(F.sum("share").alias("sum")).select(*cell, (F.col("runs") * (F.col("runs") - 1)).alias("pairs"), F.round(F.col("sum") / (F.col("runs") * (F.col("runs") - 1)), 4).alias("reproducibility"))
