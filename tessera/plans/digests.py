"""Queries on digests, vectors and windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests, embeddings, sampling
from ..session import table
from ..streaming import recovery
from .registry import query

_TITLES = ["Court sentences an ex-official", "Weather", "Missile strike near Natanz", "Uranium enrichment resumes", "A concert", "Troops advance near Pokrovsk"]
_LISTED = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    title = F.get(F.array(*[F.lit(t) for t in _TITLES]), (F.col("doc_id") % len(_TITLES)).cast("int"))
    rel = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).alias("rel"))
    return table(spark, sf, "documents").where("n_chars >= 40").join(rel, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("none")).alias("cell"), "source", "n_chars", "rel", title.alias("title"), "text")


@query(
    "track_documents",
    f"""
    WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS cell, source, n_chars, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.2 END AS rel, {_LISTED}[CAST(1 + doc_id % {len(_TITLES)} AS BIGINT)] AS title, text FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 40),
    a AS (SELECT *, row_number() OVER (PARTITION BY cell, source ORDER BY coalesce(rel, 0.3) DESC, n_chars DESC NULLS LAST, doc_id) AS i FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY coalesce(rel, 0.3) DESC, n_chars DESC NULLS LAST, doc_id) AS place FROM a WHERE i <= 40)
    SELECT doc_id, cell, CAST(place AS INTEGER) AS place FROM b WHERE place <= 100 AND regexp_matches(substring(concat(title, ' ', text), 1, 1500), '{digests.NUCLEAR.replace("(?iu)", "(?i)")}')""",
)
def track_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = digests.gathered(_titled(spark, sf), ["cell"], "source", "rel", "n_chars", "doc_id", 100)
    return found.where(digests.on_track(F.col("title"), F.col("text"), "nuclear")).select("doc_id", "cell", "place")


@query("extractive_digest")
def extractive_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digests.extractive(_titled(spark, sf), "cell", "doc_id", "title", "text", "rel")


@query(
    "missing_vectors",
    "SELECT doc_id FROM documents WHERE doc_id > 100 AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label % 2 = 0) ORDER BY doc_id LIMIT 128",
)
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The next batch of documents without a vector of one model (the even labels stand for it), after a checkpoint."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return embeddings.missing(table(spark, sf, "documents").select("doc_id"), vectors, "doc_id", F.col("label") % 2 == 0, 100, embeddings.REQUEST)


@query("stub_vectors")
def stub_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return embeddings.embedded(docs, "text", 64).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(
    "rolling_counts",
    "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, date_trunc('hour', ts) - INTERVAL 1 HOUR * k + INTERVAL 24 HOUR AS \"end\", event_type, count(*) AS n FROM events, range(24) t(k) GROUP BY 1, 2, 3",
)
def rolling_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = recovery.rolling_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query(
    "health_episodes",
    """
    WITH r AS (SELECT user_id AS k, ts AS t, event_id, CASE WHEN value > 60 THEN 'failures' WHEN value > 40 THEN 'empty' END AS problem FROM events),
    b AS (SELECT *, lag(coalesce(problem, '')) OVER (PARTITION BY k ORDER BY t) AS prev FROM r)
    SELECT k, t, problem, CASE WHEN problem IS NOT NULL AND (prev IS NULL OR prev <> problem) THEN 'unhealthy' WHEN problem IS NULL AND prev <> '' THEN 'recovery' END AS fire FROM b""",
)
def health_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that tell of a problem's start or end; with a cooldown longer than any episode, each tells once."""
    value = F.col("value")
    runs = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.when(value > 60, "failures").when(value > 40, "empty").alias("problem"))
    return recovery.episodes(runs, "k", "t", "problem", F.make_dt_interval(days=F.lit(1000)))


@query("numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "place")
