"""Trade panels: divergence from a baseline year, concentration of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import risk
from ..functions.text import magnitude

#: What counts as material, as a divergence, and as concentrated.
MATERIAL, MULTIPLE = 5e6, 2.0
HIGH_HHI, HIGH_TOP_SHARE = 0.4, 0.5


def divergence(flows: DataFrame, keys: list[str], period: str, value: str, baseline: str, material: float = MATERIAL, multiple: float = MULTIPLE) -> DataFrame:
    """Per key: the latest material year (else the latest) against the baseline year. One aggregate; the panel isn't sorted."""
    big = F.col(value) >= material
    each = flows.groupBy(*keys).agg(
        F.max(F.when(big, F.struct(period, value))).alias("m"),
        F.max(F.struct(period, value)).alias("l"),
        F.max(F.when(F.col(period) == baseline, F.col(value))).alias("base"),
    )
    latest = F.coalesce("m", "l")
    rows = each.select(*keys, F.coalesce("base", F.lit(0.0)).alias("baseline_usd"), latest.getField(period).alias("latest_year"), latest.getField(value).alias("latest_usd"))
    ratio = F.when(F.col("baseline_usd") >= material, F.col("latest_usd") / F.col("baseline_usd"))
    appeared = (F.col("baseline_usd") < material) & (F.col("latest_usd") >= material)
    flagged = (F.col("latest_usd") >= material) & (F.coalesce(ratio >= multiple, F.lit(False)) | appeared)
    span = F.concat(F.lit("$"), magnitude(F.col("baseline_usd")), F.lit("→$"), magnitude(F.col("latest_usd")))
    reason = F.when(~flagged, "within organic range").when(appeared, F.concat(F.lit("appeared: "), span, F.lit(f" since {baseline}"))).otherwise(F.concat(F.format_string("%.1f", ratio), F.lit("× baseline ("), span, F.lit(")")))
    return rows.select("*", F.round(ratio, 2).alias("multiple"), (F.col("latest_usd") - F.col("baseline_usd")).alias("delta_usd"), flagged.alias("flagged"), reason.alias("reason"))


def concentration(flows: DataFrame, keys: list[str], supplier: str, value: str, sensitive: list[int]) -> DataFrame:
    """Per key: HHI, the shares of the first and the first three suppliers and of sensitive ones, risk."""
    each = flows.where(F.col(value) > 0).groupBy(*keys, supplier).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(*keys)
    shares = each.withColumn("share", F.col("v") / F.sum("v").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("v"), supplier)))
    found = shares.groupBy(*keys).agg(
        F.sum("v").alias("total_usd"),
        F.min_by(supplier, "rn").alias("top_supplier"),
        F.max("share").alias("top"),
        F.sum(F.when(F.col("rn") <= 3, F.col("share"))).alias("top3"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.coalesce(F.sum(F.when(F.col(supplier).isin(sensitive), F.col("share"))), F.lit(0.0)).alias("exposed"),
    )
    pct = lambda c: F.round(F.col(c) * 100, 1)
    return found.select(
        *keys,
        F.round("total_usd", 0).alias("total_usd"),
        "top_supplier",
        pct("top").alias("top_share_pct"),
        pct("top3").alias("top3_share_pct"),
        F.round("hhi", 3).alias("hhi"),
        pct("exposed").alias("sensitive_share_pct"),
        ((F.col("hhi") >= HIGH_HHI) | (F.col("top") >= HIGH_TOP_SHARE)).alias("concentrated"),
        risk(F.round("hhi", 3), pct("exposed")).alias("risk"),
    )
