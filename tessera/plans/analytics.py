"""Analytical queries: near-duplicates, matching, trade, freshness, ranking, retrieval, language."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import claims, freshness, near_duplicates, reduction, retrieval, trade, validation
from ..session import table
from .registry import picked, picked_sql, query


def _cents(column: str):
    """Money as decimals: sums don't hang on the order of rows."""
    return F.col(column).cast("decimal(18, 2)")


def _flows(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    """Revenue by year from lineitem: the panel of trade flows."""
    t = lambda n: table(spark, sf, n)
    items = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (_cents("l_extendedprice") * (1 - _cents("l_discount"))).alias("usd"))
    years = t("orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("period"))
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    parts = t("part").select("p_partkey", "p_type", "p_brand")
    joined = items.join(years, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(*keys, "period").agg(F.sum("usd").cast("double").alias("usd"))


_FLOWS_SQL = """
flows AS (SELECT {keys}, CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(18, 2)))) AS DOUBLE) AS usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY {keys}, period)"""


@query(
    "trade_divergence",
    "WITH "
    + _FLOWS_SQL.format(keys="n_name")
    + """,
    g AS (SELECT n_name, coalesce(max(CASE WHEN usd >= 100000 THEN {'p': period, 'v': usd} END), max({'p': period, 'v': usd})) AS l,
        coalesce(max(usd) FILTER (WHERE period = '1995'), 0) AS baseline_usd FROM flows GROUP BY n_name),
    r AS (SELECT n_name, baseline_usd, l.p AS latest_year, l.v AS latest_usd, CASE WHEN baseline_usd >= 100000 THEN l.v / baseline_usd END AS ratio FROM g)
    SELECT n_name, baseline_usd, latest_year, latest_usd, round(ratio, 2) AS multiple, latest_usd - baseline_usd AS delta_usd,
      latest_usd >= 100000 AND (coalesce(ratio >= 2.0, false) OR baseline_usd < 100000) AS flagged FROM r""",
)
def trade_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return trade.divergence(_flows(spark, sf, ["n_name"]), ["n_name"], "period", "usd", "1995", material=1e5).drop("reason")


@query(
    "concentration_hhi",
    "WITH "
    + _FLOWS_SQL.format(keys="p_brand, l_suppkey")
    + """,
    s AS (SELECT p_brand, l_suppkey, sum(usd) AS v FROM flows WHERE period = (SELECT max(period) FROM flows) AND usd > 0 GROUP BY 1, 2),
    w AS (SELECT *, v / sum(v) OVER (PARTITION BY p_brand) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, l_suppkey) AS rn FROM s),
    c AS (SELECT p_brand, round(sum(v), 0) AS total_usd, min_by(l_suppkey, rn) AS top_supplier, max(share) AS top, sum(share) FILTER (WHERE rn <= 3) AS top3, sum(share * share) AS hhi,
        coalesce(sum(share) FILTER (WHERE l_suppkey IN (1, 2, 3, 4, 5)), 0) AS exposed FROM w GROUP BY p_brand)
    SELECT p_brand, total_usd, top_supplier, round(top * 100, 1) AS top_share_pct, round(top3 * 100, 1) AS top3_share_pct, round(hhi, 3) AS hhi, round(exposed * 100, 1) AS sensitive_share_pct,
      hhi >= 0.4 OR top >= 0.5 AS concentrated, round(0.5 * least(1.0, round(hhi, 3) / 0.6) + 0.5 * round(exposed * 100, 1) / 100, 3) AS risk FROM c""",
)
def concentration_hhi(spark: SparkSession, sf: str) -> DataFrame:
    flows = _flows(spark, sf, ["p_brand", "l_suppkey"])
    last = table(spark, sf, "orders").agg(F.max(F.year("o_orderdate").cast("string")).alias("last"))
    latest = flows.join(F.broadcast(last), F.col("period") == F.col("last"))
    return trade.concentration(latest, ["p_brand"], "l_suppkey", "usd", [1, 2, 3, 4, 5])


@query(
    "freshness_state",
    """
    WITH l AS (SELECT user_id, event_type, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, last, CAST(date_diff('day', last, DATE '2024-02-01') AS INTEGER) AS age_days,
      CASE WHEN date_diff('day', last, DATE '2024-02-01') > 2 * (CASE WHEN event_type = 'error' THEN 1 ELSE 2 END) THEN 'stale' ELSE 'ok' END AS status FROM l""",
)
def freshness_state(spark: SparkSession, sf: str) -> DataFrame:
    cadence = F.when(F.col("event_type") == "error", 1).otherwise(2)
    return freshness.cadence_status(table(spark, sf, "events"), ["user_id", "event_type"], "ts", F.lit("2024-02-01").cast("date"), cadence)


_TRACKS = {"error": 1.8, "purchase": 1.4, "click": 0.6}


@query(
    "profile_rank",
    """
    WITH g AS (SELECT user_id, event_type, count(*) AS n, round(avg(value) / 100, 6) AS confidence, max(ts) AS latest FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, n, round((CASE event_type WHEN 'error' THEN 1.8 WHEN 'purchase' THEN 1.4 WHEN 'click' THEN 0.6 ELSE 1.0 END) * (1 + ln(1 + n)) * (0.5 + coalesce(confidence, 0.4))
      * (0.4 + 0.6 * pow(0.5, date_diff('microsecond', latest, TIMESTAMP '2024-02-01 00:00:00') / 3.6e9 / 48)), 3) AS score FROM g""",
)
def profile_rank(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value") / 100, 6).alias("confidence"), F.max("ts").alias("latest"))
    track = F.lit(1.0)
    for kind, weight in _TRACKS.items():
        track = F.when(F.col("event_type") == kind, F.lit(weight)).otherwise(track)
    one, as_of = F.lit(1.0), F.lit("2024-02-01 00:00:00").cast("timestamp")
    score = scores.profile_score(track, one, one, F.col("n"), F.col("confidence"), F.col("latest"), as_of, 48)
    return groups.select("user_id", "event_type", "n", F.round(score, 3).alias("score"))


def _probe(n: int = 64) -> list[float]:
    return [round(math.sin(i + 1), 6) for i in range(n)]


_PROBE_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _probe()) + "]"
_VECTOR_SQL = f"SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_PROBE_SQL}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 150"


@query("vector_topk", _VECTOR_SQL)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_arm(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", _probe(), 150, "vec_id").select("vec_id", "score")


@query(
    "hybrid_union",
    f"""
    WITH v AS ({_VECTOR_SQL}), k AS (SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%apache%'),
    u AS (SELECT coalesce(vec_id, doc_id) AS id, score, doc_id IS NOT NULL AS lexical_hit FROM v FULL JOIN k ON vec_id = doc_id)
    SELECT id, score, lexical_hit, round(coalesce(score, 0.55) * 0.25 * 0.75, 6) AS composite FROM u ORDER BY composite DESC, id LIMIT 300""",
)
def hybrid_union(spark: SparkSession, sf: str) -> DataFrame:
    vector = retrieval.vector_arm(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding", _probe(), 150, "id")
    keyword = retrieval.keyword_arm(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"), ["license", "apache"])
    both = retrieval.union_arms(vector, keyword, "id", "score")
    none = F.lit(None)
    score = scores.composite(F.col("score"), none.cast("date"), none.cast("double"), F.lit("2024-02-01").cast("date"))
    return both.withColumn("composite", F.round(score, 6)).orderBy(F.desc("composite"), "id").limit(300)


@query(
    "keyword_retrieve",
    "SELECT doc_id, source FROM documents WHERE text ILIKE '%gnu general%' OR text ILIKE '%mit license%' OR source IN (SELECT source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND d.source = 'src3') ORDER BY doc_id LIMIT 500",
)
def keyword_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    named = docs.where("source = 'src3'").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("source").distinct().withColumn("named", F.lit(True))
    marked = docs.join(named, "source", "left")
    return retrieval.keyword_arm(marked, F.col("text"), ["gnu general", "mit license"], F.coalesce("named", F.lit(False))).select("doc_id", "source").orderBy("doc_id").limit(500)


@query(
    "lang_counts",
    """
    WITH c AS (SELECT lang, length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g')) AS latin FROM documents WHERE text IS NOT NULL)
    SELECT lang, CASE WHEN latin < 5 THEN NULL ELSE 'en' END AS script, count(*) AS n FROM c GROUP BY 1, 2""",
)
def lang_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").groupBy("lang", text.detect_language(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


_SCRIPTS = ["Войска наступают у города", "Війська їхні є біля ґанку і їдуть", "قوات الجيش تتقدم", "نیروها گفتند که پهپاد می‌آید", "Troops advance", "12 34", "ӑҫта тата ҫак пулнӑ вӑл", "ҡала ғына һәм ҙур булған", "җир әле өчен үткән", "ӏалам дара нохчийн ӏуьйре", "da да", ""]
_SCRIPT_SQL = "length(s) - length(regexp_replace(s, '[{0}]', '', 'g'))"


@query(
    "script_languages",
    f"WITH v AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE concat({picked_sql(_SCRIPTS, 'doc_id')}, ' ', source) END AS s FROM documents), c AS (SELECT doc_id, s, {_SCRIPT_SQL.format('Ѐ-ӿ')} AS cy, {_SCRIPT_SQL.format('؀-ۿ')} AS ar, {_SCRIPT_SQL.format('a-zA-Z')} AS la FROM v) "
    + "SELECT doc_id, CASE WHEN cy < 5 AND la < 5 AND ar < 5 THEN NULL WHEN ar >= 5 AND ar >= cy AND ar >= la THEN CASE WHEN regexp_matches(s, '[پچژگکی]') THEN 'fa' ELSE 'ar' END WHEN cy <= la THEN 'en' "
    + "WHEN (regexp_matches(lower(s), '[ӑӗӳ]') OR regexp_matches(lower(s), 'ҫак|тата')) AND regexp_matches(s, 'ҫ') THEN 'cv' WHEN regexp_matches(s, '[ҡғҙ]') THEN 'ba' WHEN regexp_matches(s, 'җ') AND regexp_matches(s, '[әөү]') THEN 'tt' WHEN regexp_matches(s, 'ӏ') THEN 'ce' "
    + f"WHEN {_SCRIPT_SQL.format('іїєґІЇЄҐ')} > {_SCRIPT_SQL.format('ыъэёЫЪЭЁ')} THEN 'uk' ELSE 'ru' END AS lang FROM c",
)
def script_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, and sources' names after words of other scripts."""
    i = F.col("doc_id")
    s = F.when(i % 4 == 0, F.col("text")).otherwise(F.concat(picked(_SCRIPTS, i), F.lit(" "), "source"))
    return table(spark, sf, "documents").select("doc_id", text.detect_language(s).alias("lang"))


_SENTENCES = [
    "ISW cannot independently verify the claim", "ISW has not yet observed footage", "Unverified footage shows tanks", "The purported letter", "Geolocated footage published on May 3 shows", "Footage posted by a channel confirms it",
    "a visual confirmation", "Satellite imagery captured the base", "The ministry confirmed it", "ISW continues to assess that", "ISW previously reported it", "They are likely to attack", "He claims victory", "Reportedly, he left", "The channel reported that it fell",
    "The minister said so", "A source indicated otherwise", "Nothing is said of it here", "It rained", "",
]


@query(
    "hedging_rules",
    f"WITH v AS (SELECT conv_id, turn, concat(text, '. ', {picked_sql(_SENTENCES, 'conv_id + turn')}) AS s FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN '{k}'" for k, p in text.HEDGING_RULES)
    + " ELSE 'unknown' END AS hedging, CASE "
    + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN substring(regexp_extract(s, '(?i){p}', 1), 1, 60)" for _, p in text.HEDGING_RULES)
    + " END AS cue, CASE "
    + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN {text.HEDGING_WEIGHTS[k]}e0" for k, p in text.HEDGING_RULES)
    + " ELSE 0.5e0 END AS weight FROM v",
)
def hedging_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations that end in a sentence that hedges."""
    said = F.concat("text", F.lit(". "), picked(_SENTENCES, F.col("conv_id") + F.col("turn")))
    rows = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", said.alias("s"))
    kind = text.hedging(F.col("s"))
    return rows.select("conv_id", "turn", kind.alias("hedging"), text.hedging_cue(F.col("s")).alias("cue"), text.hedging_weight(kind).alias("weight"))


@query(
    "composite_scores",
    """
    SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 499979 END, 0.55) * CASE WHEN o_orderkey % 5 = 0 THEN 0.25 ELSE pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01'), 0) / 30) END
      * (0.5 + 0.5 * coalesce(CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.2 END, 0.5)), 5) AS score FROM orders""",
)
def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = scores.composite(F.when(k % 3 != 0, F.col("o_totalprice") / 499979), F.when(k % 5 != 0, F.to_date("o_orderdate")), F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.2), F.lit("1998-06-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(found, 5).alias("score"))


@query(
    "profile_scores",
    """
    SELECT event_id, round((CASE event_type WHEN 'error' THEN 1.8 WHEN 'purchase' THEN 1.4 ELSE 0.6 END) * (CASE event_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.7 END) * greatest(CASE event_id % 2 WHEN 0 THEN 1.2 ELSE 0.8 END, CASE event_id % 5 WHEN 0 THEN 1.3 ELSE 0.5 END)
      * (1 + ln(1 + event_id % 7)) * (0.5 + coalesce(CASE WHEN event_id % 4 <> 0 THEN value / 197 END, 0.4)) * (0.4 + 0.6 * CASE WHEN event_id % 11 = 0 THEN 0.5 WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 1.0 ELSE pow(0.5, date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 3.6e9 / 48) END), 4) AS score FROM events""",
)
def profile_scores(spark: SparkSession, sf: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    track = F.when(kind == "error", 1.8).when(kind == "purchase", 1.4).otherwise(0.6)
    sort = F.when(i % 3 == 0, 1.5).when(i % 3 == 1, 1.0).otherwise(0.7)
    platforms = F.array(F.when(i % 2 == 0, 1.2).otherwise(0.8), F.when(i % 5 == 0, 1.3).otherwise(0.5))
    score = scores.profile_score(track, sort, F.array_max(platforms), i % 7, F.when(i % 4 != 0, F.col("value") / 197), F.when(i % 11 != 0, F.col("ts")), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 48)
    return table(spark, sf, "events").select("event_id", F.round(score, 4).alias("score"))


@query("neardup_exact", "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))) END AS canonical FROM documents")
def neardup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.exact_mirrors(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("neardup_minhash")
def neardup_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_mirrors(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("first_seen_groups")
def first_seen_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents grouped with the first one seen, through their candidates' canonical documents."""
    return near_duplicates.first_seen_groups(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("dedup_gate")
def dedup_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Mirrors of a language's documents within a day; every tenth document is mapped already."""
    id_ = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"), F.date_add(F.lit("2024-01-01").cast("date"), (id_ % 4).cast("int")).alias("day"), (id_ % 10 == 0).alias("mapped"))
    return near_duplicates.gate(docs, "doc_id", "text", "day", "lang", "mapped")


_NORMAL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    "shingle_jaccard_pairs",
    f"""
    WITH f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))),
    w AS (SELECT doc_id, list_filter(string_split({_NORMAL_SQL}, ' '), lambda x: x <> '') AS w FROM documents JOIN f USING (doc_id)),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s), p AS (SELECT a.doc_id AS "left", b.doc_id AS "right", count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT "left", "right", round(j, 6) AS jaccard FROM p WHERE round(j, 6) >= 0.7""",
)
def shingle_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.shingle_pairs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


_TOKENS_SQL = """list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+'),
  lambda w: w <> '' AND (length(w) >= 2 OR regexp_matches(w, '[0-9]')) AND NOT list_contains([{1}], w)))"""
_STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(
    "best_match_takeaway",
    f"""
    WITH b AS (SELECT item_id, {_TOKENS_SQL.format("text", _STOP_SQL)} AS s FROM benchmark), d AS (SELECT doc_id, {_TOKENS_SQL.format("text", _STOP_SQL)} AS s FROM documents),
    bt AS (SELECT item_id, len(s) AS m, unnest(s) AS t FROM b), dt AS (SELECT doc_id, unnest(s) AS t FROM d),
    p AS (SELECT item_id, doc_id, round(count(*) / any_value(m), 6) AS score FROM bt JOIN dt USING (t) GROUP BY 1, 2)
    SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM p WHERE score >= 0.6) WHERE rn = 1""",
)
def best_match_takeaway(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", text.token_set(F.col("text")).alias("t"))
    docs = table(spark, sf, "documents").select("doc_id", text.token_set(F.col("text")).alias("t"))
    return validation.best_match(items, docs, "item_id", "doc_id", "t", F.round(F.col("shared") / F.col("left_size"), 6), 0.6, 0.6)


def claims_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of a source and language with their texts and actors (here their sources). The table has no times, so all are of one window and day: each may meet each."""
    return table(spark, sf, "documents").select(
        "source", "lang", F.lit(0).cast("bigint").alias("window"), "doc_id", "text", text.token_set(F.col("text")).alias("tokens"), F.array_compact(F.array("source")).alias("actors"), F.lit("2024-01-01").cast("date").alias("day")
    )


@query("star_clusters")
def star_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return claims.star_clusters(claims_of_documents(spark, sf), ["source", "lang", "window"], "doc_id", "tokens", "actors", None, "day", "text")


@query("source_mix")
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "doc_id", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("platform"), "n_chars")
    return claims.source_mix(docs, ["lang"], "doc_id", "source", "platform", [F.desc("n_chars"), F.col("doc_id")], 120)


@query(
    "group_facts",
    """
    WITH d AS (SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h, doc_id, source, CAST(CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.2 END AS DOUBLE) AS r FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL)
    SELECT h, count(*) AS docs, round(avg(coalesce(r, 0.3)), 6) AS confidence, max(coalesce(r, CAST(0.3 AS DOUBLE))) AS best, CASE WHEN count(source) > 0 THEN 1 ELSE 0 END AS independent, 'claimed' AS hedging FROM d GROUP BY h""",
)
def group_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Mirrors as groups of claims: however many sources repeat a text, they are one, and nothing is confirmed."""
    quality = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).alias("reliability"))
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", text.content_md5(F.col("text")).alias("h")).join(quality, "doc_id", "left")
    none = F.lit(None).cast("string")
    claims_ = docs.select(
        "h",
        F.col("doc_id").alias("claim"),
        F.col("doc_id").alias("doc"),
        F.hash("h").alias("canonical"),
        F.col("source").alias("domain"),
        "reliability",
        F.lit("factual").alias("claim_type"),
        F.lit("claimed").alias("hedging"),
        F.lit(False).alias("quote_verified"),
        *[none.alias(c) for c in ("text", "quote", "hint")],
        F.lit(None).cast("date").alias("day"),
        F.lit(None).cast("timestamp").alias("published"),
    )
    return reduction.groups(claims_, ["h"]).select("h", "docs", "confidence", "best", "independent", "hedging")


_THRESHOLDS = [0.2, 0.35, 0.5, 0.65, 0.8]


@query(
    "threshold_sweep",
    f"""
    WITH p AS (SELECT value / 100 AS s, event_type = 'error' AS y FROM events WHERE value IS NOT NULL), t AS (SELECT unnest({_THRESHOLDS}) AS threshold),
    c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE s >= threshold AND y) AS tp, count(*) FILTER (WHERE s >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE s < threshold AND y) AS fn FROM p, t GROUP BY threshold)
    SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM c""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "events").where("value is not null").select((F.col("value") / 100).alias("s"), (F.col("event_type") == "error").alias("y"))
    return claims.threshold_sweep(pairs, "s", "y", _THRESHOLDS)


@query(
    "hedging_by_source",
    r"""
    WITH s AS (SELECT source, unnest(regexp_extract_all(text, '[^.\n]+\.')) AS s FROM documents WHERE text IS NOT NULL)
    SELECT source, CASE WHEN regexp_matches(s, '(?i)\b(purported(?:ly)?)\b') THEN 'unverified' WHEN regexp_matches(s, '(?i)\b(confirmed)\b') THEN 'confirmed'
      WHEN regexp_matches(s, '(?i)\b(claimed|claims|claiming)\b') THEN 'claimed' WHEN regexp_matches(s, '(?i)\b(stated|said|announced|asserted|denied|acknowledged|warned|amplified|told)\b') THEN 'claimed' ELSE 'unknown' END AS hedging, count(*) AS n FROM s GROUP BY 1, 2""",
)
def hedging_by_source(spark: SparkSession, sf: str) -> DataFrame:
    sentences = table(spark, sf, "documents").select("source", F.explode(text.ended_sentences(F.col("text"))).alias("s"))
    return sentences.groupBy("source", text.hedging(F.col("s")).alias("hedging")).agg(F.count("*").alias("n"))


@query("content_keys", "SELECT doc_id, sha256(concat(source, '|', doc_id, '|', '', '|', substring(coalesce(text, ''), 1, 4000))) AS content_hash, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed FROM documents")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("doc_id").cast("string"), none, F.col("text")).alias("content_hash"), text.content_md5(F.col("text")).alias("squeezed"))


@query(
    "series_states",
    """
    WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS d FROM orders),
    r AS (SELECT *, CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END AS http, CASE WHEN k % 13 = 0 THEN 100 ELSE 1000 END AS size, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'odd' WHEN k % 3 = 0 THEN strftime(d, '%Y') ELSE strftime(d, '%d.%m.%Y') END AS period,
      CASE WHEN k % 5 = 0 THEN strftime(d + 40, '%d.%m.%Y') WHEN k % 5 = 1 THEN 'odd' END AS previous, CASE WHEN k % 17 = 0 THEN 'classified' ELSE 'open' END AS baseline FROM o),
    t AS (SELECT *, CASE WHEN period = 'odd' OR period IS NULL THEN NULL WHEN length(period) = 4 THEN CAST(date_trunc('year', d) AS DATE) ELSE d END AS begins, CASE WHEN k % 5 = 0 THEN d + 40 END AS stored FROM r),
    j AS (SELECT *, date_diff('day', CASE WHEN coalesce(begins < stored, false) THEN stored + 1 WHEN length(period) = 4 THEN CAST(begins + INTERVAL 12 MONTH AS DATE) ELSE begins + 1 END, DATE '2016-06-01') AS age FROM t)
    SELECT k AS o_orderkey, CASE WHEN baseline = 'classified' AND NOT coalesce(http = 200 AND period IS NOT NULL, false) THEN 'classified' WHEN http IS NULL THEN 'unreachable' WHEN http = 404 OR (http = 200 AND size < 500) THEN 'gone' WHEN http >= 400 THEN 'unreachable' WHEN period IS NULL THEN 'ok'
      WHEN coalesce(CASE WHEN begins IS NOT NULL THEN age > 60 ELSE period = previous AND k % 100 > 60 END, false) THEN 'stale' ELSE 'ok' END AS status FROM j""",
)
def series_states(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as series of statistics: every state, by answers, sizes, periods that are read or not, and periods that went back."""
    k, d = F.col("o_orderkey"), F.to_date(F.col("o_orderdate") + F.make_ym_interval(F.lit(20)))
    shown = lambda x: F.date_format(x, "dd.MM.yyyy")
    period = F.when(k % 7 == 0, None).when(k % 7 == 1, "odd").when(k % 3 == 0, F.date_format(d, "yyyy")).otherwise(shown(d))
    previous = F.when(k % 5 == 0, shown(F.date_add(d, 40))).when(k % 5 == 1, "odd")
    http = F.when(k % 11 == 0, None).when(k % 11 == 1, 404).when(k % 11 == 2, 500).otherwise(200)
    status = freshness.series_status(http, F.when(k % 13 == 0, 100).otherwise(1000), period, previous, F.when(k % 17 == 0, "classified").otherwise("open"), F.lit(30), k % 100, F.lit("2016-06-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", status.alias("status"))
