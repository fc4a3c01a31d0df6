"""Claims to groups: pair scores, what a group of claims says, independent sources, and the order of groups.

A claim is a row: claim (id), doc, text, claim_type, hedging, reliability, domain, canonical (of the document's mirrors), quote, quote_verified,
hint, day, published, entities (array of name, kind, role). Groups are what star clustering gives: each is of one cell and no larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores, text

#: Independent sources from which on a claim counts as confirmed.
INDEPENDENT = 2


def pair_score(tokens: tuple[Column, Column], entities: tuple[Column, Column], hints: tuple[Column, Column], days: tuple[Column, Column]) -> Column:
    """How alike two claims are, from 0 to 1: texts, entities and hints, weighed over those that both have. -1 for claims that are more than
    a day apart or undated."""
    total, weight = F.lit(scores.PAIR_WEIGHTS[0]) * text.jaccard(*tokens), F.lit(scores.PAIR_WEIGHTS[0])
    for (a, b), w in zip((entities, hints), scores.PAIR_WEIGHTS[1:]):
        both = (F.size(a) > 0) & (F.size(b) > 0)
        total += F.when(both, F.lit(w) * text.jaccard(a, b)).otherwise(0.0)
        weight += F.when(both, F.lit(w)).otherwise(0.0)
    return F.when(F.coalesce(F.abs(F.datediff(*days)) <= 1, F.lit(False)), total / weight).otherwise(F.lit(-1.0))


def independent(links: Column) -> Column:
    """How many sources are independent, of an array of (document, domain): parts of the graph in which a document's mirrors and a
    domain's documents hang together. Documents without a domain prove nothing."""
    pairs = F.transform(
        F.filter(links, lambda x: x.getField("domain").isNotNull() & (x.getField("domain") != "")),
        lambda x: F.array(F.concat(F.lit("d:"), x.getField("document").cast("string")), F.concat(F.lit("s:"), x.getField("domain"))),
    )

    def joined(parts: Column, pair: Column) -> Column:
        touched = F.filter(parts, lambda p: F.arrays_overlap(p, pair))
        return F.concat(F.filter(parts, lambda p: ~F.arrays_overlap(p, pair)), F.array(F.array_distinct(F.concat(F.flatten(touched), pair))))

    return F.size(F.aggregate(F.array_distinct(pairs), F.array().cast("array<array<string>>"), joined))


def mode(df: DataFrame, keys: list[str], value: str, *before_name: Column) -> DataFrame:
    """Of each key the most frequent value; ties by before_name (smaller first), then by the value itself."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), *[F.min(c).alias(f"__{i}") for i, c in enumerate(before_name)])
    place = F.struct(-F.col("__n"), *[F.col(f"__{i}") for i in range(len(before_name))], value)
    return counts.groupBy(*keys).agg(F.min_by(value, place).alias(value))


def groups(claims: DataFrame, group: list[str]) -> DataFrame:
    """Of each group: key (its first claim), claims, docs, independent, text, claim_type, hedging, promoted, confidence, best, quote,
    hint, first_day, latest.

    The text is the one of the most reliable claim (ties: a verified quote, the smaller id). One factual claim makes a group factual; its hedging
    is the strongest of its factual claims, and confirmed where INDEPENDENT sources claim it. Mirrors are one source. Confidence is the mean over documents.
    """
    rel = scores.reliability(F.col("reliability"))
    ladder = F.array(*[F.lit(h) for h in text.HEDGING_LADDER])
    verified = F.coalesce("quote_verified", F.lit(False))
    place = F.struct(-rel, F.when(verified, 0).otherwise(1), "claim")
    factual = F.col("claim_type") == "factual"
    link = F.struct(F.coalesce("canonical", "doc").alias("document"), F.col("domain").alias("domain"))
    whole = claims.groupBy(*group).agg(
        F.min("claim").alias("key"),
        F.count("*").alias("claims"),
        F.min_by("text", place).alias("text"),
        F.min_by("hint", place).alias("__hint"),
        F.bool_and(F.col("claim_type") == "assessment").alias("__assessment"),
        F.min(F.when(factual, F.array_position(ladder, F.col("hedging")))).alias("__strongest"),
        F.collect_set(link).alias("__links"),
        F.collect_set(F.when(factual & (F.col("hedging") == "claimed"), link)).alias("__asserting"),
        F.min_by("quote", F.when(verified & F.col("quote").isNotNull(), F.struct(-rel, F.col("claim")))).alias("quote"),
        F.min("day").alias("first_day"),
        F.max("published").alias("latest"),
    )
    by_doc = claims.groupBy(*group, "doc").agg(F.min_by(rel, "claim").alias("r"))
    docs = by_doc.groupBy(*group).agg(F.count("*").alias("docs"), F.round(F.avg("r"), 6).alias("confidence"), F.max("r").alias("best"))
    own = claims.where("hint is not null").join(whole.select(*group, "__hint"), group)
    hints = mode(own, group, "hint", F.when(F.col("hint").eqNullSafe(F.col("__hint")), 0).otherwise(1))
    strongest = F.coalesce(F.get(ladder, F.col("__strongest").cast("int") - 1), F.lit("unknown"))
    promoted = ~F.col("__assessment") & (strongest != "confirmed") & (independent(F.col("__asserting")) >= INDEPENDENT)
    return (
        whole.join(docs, group)
        .join(hints, group, "left")
        .select(
            *group,
            "key",
            "claims",
            "docs",
            independent(F.col("__links")).alias("independent"),
            "text",
            F.when(F.col("__assessment"), "assessment").otherwise("factual").alias("claim_type"),
            F.when(F.col("__assessment"), "assessed").when(promoted, "confirmed").otherwise(strongest).alias("hedging"),
            promoted.alias("promoted"),
            "confidence",
            "best",
            "quote",
            "hint",
            "first_day",
            "latest",
        )
    )


def group_entities(claims: DataFrame, group: list[str], places: list[str] | None = None) -> DataFrame:
    """Of each group and named actor (junk left out, spellings folded): its most frequent name, kind and role (ties: plain ASCII, then by name)."""
    rows = claims.select(*group, F.explode("entities").alias("e")).select(*group, "e.*").where("name <> ''")
    rows = rows.where(names.junk_reason(F.col("name"), F.col("kind"), places or []).isNull()).withColumn("actor", names.key(F.col("name"))).where("actor <> ''")
    keys = [*group, "actor"]
    ascii_first = lambda c: F.when(F.col(c).rlike("^[ -~]+$"), 0).otherwise(1)
    out = mode(rows, keys, "name", ascii_first("name"))
    for c in ("kind", "role"):
        out = out.join(mode(rows, keys, c, ascii_first(c)), keys)
    return out


def ranked(found: DataFrame, as_of: Column) -> DataFrame:
    """Groups with score, in their order: by score, independent sources, key."""
    score = scores.group_score(F.col("independent"), F.col("best"), F.col("claims"), F.col("latest"), as_of)
    return found.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc("independent"), "key")
