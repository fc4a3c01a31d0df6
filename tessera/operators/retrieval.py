"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cosine


def keyword_arm(claims: DataFrame, text: str, terms: list[str], also: Column | None = None) -> DataFrame:
    """Claims with any of the terms (case doesn't matter), or for which `also` holds."""
    if not terms and also is None:
        return claims.limit(0)
    hit = F.lit(False) if also is None else also
    for t in terms:
        hit = hit | F.lower(text).contains(t.lower())
    return claims.where(hit)


def term_rank(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text has, over the log of its length: an order for keyword hits."""
    n = sum((F.when(F.lower(text).contains(t.lower()), F.lit(1)).otherwise(F.lit(0)) for t in terms), F.lit(0))
    return n / F.log(F.length(text) + F.lit(2.0))


def vector_arm(vectors: DataFrame, column: str, query: list[float], k: int, order: str, name: str = "score") -> DataFrame:
    """The k vectors with the largest cosine similarity (ties: the smaller id). Each task keeps k rows."""
    scored = vectors.withColumn(name, F.round(cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])), 6))
    return scored.where(F.col(name).isNotNull()).orderBy(F.desc(name), order).limit(k)


def union_arms(vector: DataFrame, keyword: DataFrame, key: str, score: str) -> DataFrame:
    """Both arms by key: the vector score where there is one, and whether keywords hit."""
    rows = vector.select(key, score, F.lit(False).alias("lexical_hit")).unionByName(keyword.select(key, F.lit(None).cast("double").alias(score), F.lit(True).alias("lexical_hit")))
    return rows.groupBy(key).agg(F.max(score).alias(score), F.bool_or("lexical_hit").alias("lexical_hit"))
