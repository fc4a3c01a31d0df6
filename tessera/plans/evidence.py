"""Queries on evidence, answers and usage: summaries, changes against before, resolution of references, metrics, allowances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quotes, text
from ..operators import keyed
from ..session import table
from .registry import query


@query(
    "evidence_summary",
    """
    SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS claim, count(*) AS docs, count(DISTINCT source) AS channels, count(DISTINCT lang) AS platforms, min(doc_id) AS earliest
    FROM documents GROUP BY 1""",
)
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", text.content_md5(F.col("text")).alias("claim"))
    return docs.groupBy("claim").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("channels"), F.count_distinct("lang").alias("platforms"), F.min("doc_id").alias("earliest"))


@query(
    "best_per_channel",
    """
    WITH c AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS a FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS b FROM c WHERE a = 1)
    SELECT lang, source, doc_id, CAST(b AS INTEGER) AS place FROM p WHERE b <= 6""",
)
def best_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("n_chars"), F.col("doc_id")]
    channels = keyed.top_per_group(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], order, 1).drop("rn")
    return keyed.top_per_group(channels, ["lang"], order, 6, "place").select("lang", "source", "doc_id", "place")


@query(
    "interleaved_sources",
    """
    SELECT doc_id, source FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents)
    ORDER BY r, n_chars DESC NULLS LAST, doc_id LIMIT 200""",
)
def interleaved_sources(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("n_chars"), F.col("doc_id")]
    ranked = keyed.top_per_group(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source"], order, 200, "r")  # no later row can be among the first 200
    return ranked.orderBy("r", *order).limit(200).select("doc_id", "source")


@query(
    "delta_classes",
    """
    WITH n AS (SELECT source, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), o AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 <> 0),
    g AS (SELECT source, count(*) AS docs, count(o.h) AS seen FROM n LEFT JOIN o USING (h) GROUP BY source)
    SELECT source, docs, seen, CASE WHEN seen = 0 THEN 'new' WHEN seen < docs THEN 'changed' ELSE 'unchanged' END AS delta FROM g""",
)
def delta_classes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    before = docs.where("doc_id % 2 <> 0").select("h").distinct().withColumn("there", F.lit(1))
    groups = docs.where("doc_id % 2 = 0").join(before, "h", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("there").alias("seen"))
    return groups.withColumn("delta", F.when(F.col("seen") == 0, "new").when(F.col("seen") < F.col("docs"), "changed").otherwise("unchanged"))


_PREFIX_SQL = r"substring(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\S+', ' ', 'g'), '[^\p{{L}}\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g')), 1, 60)"


@query(
    "gold_resolution",
    f"""
    WITH d AS (SELECT doc_id, md5(text) AS h, {_PREFIX_SQL.format("text")} AS p FROM documents WHERE text IS NOT NULL),
    e AS (SELECT h, min(doc_id) AS exact_id FROM d GROUP BY h), f AS (SELECT p, min(doc_id) AS prefix_id FROM d GROUP BY p)
    SELECT item_id, coalesce(exact_id, prefix_id) AS doc_id, exact_id IS NOT NULL AS exact FROM benchmark b LEFT JOIN e ON md5(b.text) = e.h LEFT JOIN f ON {_PREFIX_SQL.format("b.text")} = f.p""",
)
def gold_resolution(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"), text.prefix_key(F.col("text")).alias("p"))
    items = table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("h"), text.prefix_key(F.col("text")).alias("p"))
    exact, prefix = docs.groupBy("h").agg(F.min("doc_id").alias("exact_id")), docs.groupBy("p").agg(F.min("doc_id").alias("prefix_id"))
    found = items.join(exact, "h", "left").join(prefix, "p", "left")
    return found.select("item_id", F.coalesce("exact_id", "prefix_id").alias("doc_id"), F.col("exact_id").isNotNull().alias("exact"))


@query(
    "eval_metrics",
    """
    SELECT count(*) AS questions, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS recall_pct, round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(*) FILTER (WHERE quality = 1), 0), 2) AS citation_pct,
      round(avg(n_chars), 4) AS mean_size, median(n_chars) AS p50_size FROM labels JOIN documents USING (doc_id)""",
)
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return rows.agg(
        F.count("*").alias("questions"),
        F.round(good * 100.0 / F.count("*"), 2).cast("double").alias("recall_pct"),
        F.round(F.try_divide(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)) * 100.0, good), 2).cast("double").alias("citation_pct"),
        F.round(F.avg("n_chars"), 4).alias("mean_size"),
        F.median("n_chars").alias("p50_size"),
    )


@query(
    "usage_decisions",
    """
    WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2)
    SELECT user_id, day, calls, CASE WHEN errors > 1 THEN 'blocked' WHEN calls > 4 THEN 'daily cap' WHEN calls > 2 THEN 'warn' ELSE 'ok' END AS decision FROM u""",
)
def usage_decisions(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    decision = F.when(F.col("errors") > 1, "blocked").when(F.col("calls") > 4, "daily cap").when(F.col("calls") > 2, "warn").otherwise("ok")
    return days.select("user_id", "day", "calls", decision.alias("decision"))


@query(
    "billing_period",
    """
    SELECT user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0) AS units, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS today
    FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-02-05' GROUP BY user_id""",
)
def billing_period(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("ts")
    rows = table(spark, sf, "events").where((day >= F.lit("2024-01-05").cast("date")) & (day < F.lit("2024-02-05").cast("date")))
    units = F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("bigint")))
    return rows.groupBy("user_id").agg(F.coalesce(units, F.lit(0)).alias("units"), F.count_if(day == F.lit("2024-01-15").cast("date")).alias("today"))


_TERMS = ["license", "public", "general", "apache", "work"]
_HITS = " + ".join(f"(CASE WHEN list_contains(t, '{w}') THEN 1 ELSE 0 END)" for w in _TERMS)


@query(
    "term_overlap_rank",
    f"""
    WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, {_HITS} AS hits, len(list_distinct(t)) AS size FROM d)
    SELECT doc_id, hits, round(hits / ln(size + 2.0), 5) AS rank FROM r WHERE hits > 0 ORDER BY hits DESC, rank DESC, doc_id LIMIT 200""",
)
def term_overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("t"))
    hits = sum((F.array_contains("t", w).cast("int") for w in _TERMS[1:]), F.array_contains("t", _TERMS[0]).cast("int"))
    ranked = words.select("doc_id", hits.alias("hits"), F.size(F.array_distinct("t")).alias("size")).where("hits > 0")
    return ranked.select("doc_id", "hits", F.round(F.col("hits") / F.log(F.col("size") + F.lit(2.0)), 5).alias("rank")).orderBy(F.desc("hits"), F.desc("rank"), "doc_id").limit(200)


@query("quote_verification")
def quote_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document its first line as a quote, in other case and marks, and a changed one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    line = F.get(F.split("text", "\n"), 0)
    return docs.select("doc_id", quotes.verified(F.col("text"), F.upper(line)).alias("verbatim"), quotes.verified(F.col("text"), F.concat(line, F.lit(" changed"))).alias("changed"))


@query(
    "session_history",
    """
    SELECT conv_id, string_agg(concat(role, ': ', substring(text, 1, 200)), ' | ' ORDER BY turn, role, text) AS history, max(turn) AS last_turn
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
)
def session_history(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("text is not null")
    items = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns.groupBy("conv_id").agg(items.alias("items"), F.max("turn").alias("last_turn"))
    lines = F.transform("items", lambda x: F.concat(x.getField("role"), F.lit(": "), F.substring(x.getField("text"), 1, 200)))
    return grouped.select("conv_id", F.array_join(lines, " | ").alias("history"), "last_turn")


@query("running_health", "SELECT user_id, event_id, CAST(sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS episodes FROM events WHERE event_type = 'error'")
def running_health(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id", F.sum(F.when(F.col("value") > 80, 1).otherwise(0)).over(w).alias("episodes"))
