"""Queries on claims and their groups. The documents stand for claims: sources are domains, mirrors are equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import reduction
from ..session import table
from .registry import picked, picked_sql, query

_MD5 = "md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_LADDER = "['confirmed', 'claimed', 'unverified', 'assessed', 'unknown']"
#: Claims: every eleventh has no domain, every thirteenth no time, every seventh no hint. Groups: of a language and a remainder.
_CLAIMS_SQL = f"""
c AS (SELECT doc_id AS claim, doc_id AS doc, substring(text, 1, 200) AS text, CASE WHEN doc_id % 5 = 0 THEN 'assessment' ELSE 'factual' END AS claim_type,
    {_LADDER}[CAST(1 + n_chars % 5 AS BIGINT)] AS hedging, CAST(CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.2 END AS DOUBLE) AS reliability, CASE WHEN doc_id % 11 <> 0 THEN source END AS domain,
    min(doc_id) OVER (PARTITION BY {_MD5}) AS canonical, doc_id % 2 = 0 AS quote_verified, substring(text, 1, 40) AS quote, CASE WHEN doc_id % 7 <> 0 THEN substring(text, 1, 3) END AS hint,
    DATE '2024-01-01' + CAST(doc_id % 3 AS INTEGER) AS day, CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 4000) END AS published,
    coalesce(lang, 'none') AS lang, source, doc_id % 60 AS bucket FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    reliability = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).alias("reliability"))
    docs = table(spark, sf, "documents").where("text is not null").withColumn("h", text.content_md5(F.col("text")))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("canonical"))
    n, id_ = F.col("n_chars"), F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = docs.join(first, "h").join(reliability, "doc_id", "left")
    return rows.select(
        id_.alias("claim"),
        id_.alias("doc"),
        F.substring("text", 1, 200).alias("text"),
        F.when(id_ % 5 == 0, "assessment").otherwise("factual").alias("claim_type"),
        F.get(F.array(*[F.lit(h) for h in text.HEDGING_LADDER]), (n % 5).cast("int")).alias("hedging"),
        "reliability",
        F.when(id_ % 11 != 0, F.col("source")).alias("domain"),
        "canonical",
        (id_ % 2 == 0).alias("quote_verified"),
        F.substring("text", 1, 40).alias("quote"),
        F.when(id_ % 7 != 0, F.substring("text", 1, 3)).alias("hint"),
        F.date_add(F.lit("2024-01-01").cast("date"), (id_ % 3).cast("int")).alias("day"),
        F.when(id_ % 13 != 0, start + F.make_dt_interval(mins=(id_ % 4000).cast("int"))).alias("published"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        "source",
        (id_ % 60).alias("bucket"),
    )


_G = ["lang", "bucket"]
_PARTS_SQL = """
{p}e AS (SELECT DISTINCT lang, bucket, canonical AS d, domain AS s FROM c WHERE domain IS NOT NULL{where}), {p}l AS (SELECT DISTINCT a.lang, a.bucket, a.s AS x, b.s AS y FROM {p}e a JOIN {p}e b USING (lang, bucket, d)),
{p}r AS (SELECT lang, bucket, x, y FROM {p}l UNION SELECT r.lang, r.bucket, r.x, l.y FROM {p}r r JOIN {p}l l ON r.lang = l.lang AND r.bucket = l.bucket AND r.y = l.x),
{p}i AS (SELECT lang, bucket, count(DISTINCT m) AS n FROM (SELECT lang, bucket, x, min(y) AS m FROM {p}r GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_GROUPS_SQL = f"""
WITH RECURSIVE {_CLAIMS_SQL}, {_PARTS_SQL.format(p="a", where="")}, {_PARTS_SQL.format(p="b", where=" AND claim_type = 'factual' AND hedging = 'claimed'")},
o AS (SELECT *, coalesce(reliability, CAST(0.3 AS DOUBLE)) AS rel, row_number() OVER (PARTITION BY lang, bucket ORDER BY coalesce(reliability, 0.3) DESC, quote_verified DESC, claim) AS place FROM c),
g AS (SELECT lang, bucket, min(claim) AS key, count(*) AS claims, count(*) AS docs, min_by(text, place) AS text, min_by(hint, place) FILTER (WHERE place = 1) AS first_hint, bool_and(claim_type = 'assessment') AS assessment,
    min(list_position({_LADDER}, hedging)) FILTER (WHERE claim_type = 'factual') AS strongest, round(avg(rel), 6) AS confidence, max(rel) AS best, min(day) AS first_day, max(published) AS latest,
    arg_min(quote, struct_pack(a := -rel, b := claim)) FILTER (WHERE quote_verified) AS quote FROM o GROUP BY 1, 2),
h AS (SELECT lang, bucket, hint FROM (SELECT c.lang, c.bucket, c.hint, row_number() OVER (PARTITION BY c.lang, c.bucket ORDER BY count(*) DESC, CASE WHEN c.hint = any_value(p.hint) THEN 0 ELSE 1 END, c.hint) AS rn
    FROM c JOIN o p ON c.lang = p.lang AND c.bucket = p.bucket AND p.place = 1 WHERE c.hint IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1),
f AS (SELECT g.*, h.hint, CAST(coalesce(ai.n, 0) AS INTEGER) AS independent, coalesce({_LADDER}[strongest], 'unknown') AS s, NOT assessment AND coalesce({_LADDER}[strongest], 'unknown') <> 'confirmed' AND coalesce(bi.n, 0) >= 2 AS promoted
    FROM g LEFT JOIN h USING (lang, bucket) LEFT JOIN ai USING (lang, bucket) LEFT JOIN bi USING (lang, bucket))
"""
_COLUMNS = "lang, bucket, key, claims, docs, independent, text, CASE WHEN assessment THEN 'assessment' ELSE 'factual' END AS claim_type, CASE WHEN assessment THEN 'assessed' WHEN promoted THEN 'confirmed' ELSE s END AS hedging, promoted, confidence, best, quote, hint, first_day, latest"


@query("claim_groups", f"{_GROUPS_SQL} SELECT {_COLUMNS} FROM f")
def claim_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.groups(claims(spark, sf), _G)


_AGE = "greatest(date_diff('microsecond', latest, TIMESTAMP '2024-01-04 00:00:00') / 3.6e9, 0.0)"


@query(
    "ranked_groups",
    f"""{_GROUPS_SQL}, z AS (SELECT lang, bucket, key, independent, round((1 + ln(1 + independent)) * (0.3 + best) * (1 + ln(1 + claims)) * (0.4 + 0.6 * CASE WHEN latest IS NULL THEN 0.5 ELSE pow(0.5, {_AGE} / 48) END), 6) AS score FROM f)
    SELECT * FROM z ORDER BY score DESC, independent DESC, key LIMIT 100""",
)
def ranked_groups(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")
    return reduction.ranked(reduction.groups(claims(spark, sf), _G), as_of).select(*_G, "key", "independent", "score").limit(100)


_TOKENS_SQL = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND (length(w) >= 2 OR regexp_matches(w, '[0-9]')) AND NOT list_contains([{1}], w)))"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"


@query(
    "claim_pair_scores",
    f"""
    WITH {_CLAIMS_SQL}, p AS (SELECT claim, CASE WHEN claim % 17 <> 0 THEN day END AS day, {_TOKENS_SQL.format("text", _STOP)} AS t, CASE WHEN domain IS NULL THEN [] ELSE [domain, lang] END AS e, CASE WHEN hint IS NULL THEN [] ELSE {_TOKENS_SQL.format("hint", _STOP)} END AS h FROM c),
    j AS (SELECT a.claim, 0.6 * {_JACCARD.format("a.t", "b.t")} AS st, len(a.e) > 0 AND len(b.e) > 0 AS we, 0.25 * {_JACCARD.format("a.e", "b.e")} AS se, len(a.h) > 0 AND len(b.h) > 0 AS wh, 0.15 * {_JACCARD.format("a.h", "b.h")} AS sh, abs(date_diff('day', a.day, b.day)) AS apart
      FROM p a JOIN p b ON b.claim = a.claim + 1)
    SELECT claim, round(CASE WHEN coalesce(apart <= 1, false) THEN (st + CASE WHEN we THEN se ELSE 0 END + CASE WHEN wh THEN sh ELSE 0 END) / (0.6 + CASE WHEN we THEN 0.25 ELSE 0 END + CASE WHEN wh THEN 0.15 ELSE 0 END) ELSE -1 END, 6) AS score FROM j""",
)
def claim_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of each claim and the next one."""
    none = F.array().cast("array<string>")
    rows = claims(spark, sf).select(
        "claim",
        F.when(F.col("claim") % 17 != 0, F.col("day")).alias("day"),
        text.token_set(F.col("text")).alias("t"),
        F.when(F.col("domain").isNull(), none).otherwise(F.array("domain", "lang")).alias("e"),
        F.when(F.col("hint").isNull(), none).otherwise(text.token_set(F.col("hint"))).alias("h"),
    )
    other = rows.select((F.col("claim") - 1).alias("claim"), *[F.col(c).alias(f"o{c}") for c in ("day", "t", "e", "h")])
    both = rows.join(other, "claim")
    pair = lambda c: (F.col(c), F.col(f"o{c}"))
    return both.select("claim", F.round(reduction.pair_score(pair("t"), pair("e"), pair("h"), pair("day")), 6).alias("score"))


_KEY_SQL = "trim(regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N} ]', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    "group_actors",
    f"""
    WITH {_CLAIMS_SQL}, e AS (SELECT lang, bucket, CASE WHEN claim % 2 = 0 THEN upper(source) ELSE source END AS name, CASE WHEN claim % 3 = 0 THEN 'agency' ELSE 'person' END AS kind, hedging AS role FROM c WHERE source IS NOT NULL),
    k AS (SELECT *, {_KEY_SQL} AS actor FROM e),
    n AS (SELECT lang, bucket, actor, name, row_number() OVER (PARTITION BY lang, bucket, actor ORDER BY count(*) DESC, name) AS rn FROM k GROUP BY 1, 2, 3, 4), d AS (SELECT lang, bucket, actor, kind, row_number() OVER (PARTITION BY lang, bucket, actor ORDER BY count(*) DESC, kind) AS rn FROM k GROUP BY 1, 2, 3, 4),
    r AS (SELECT lang, bucket, actor, role, row_number() OVER (PARTITION BY lang, bucket, actor ORDER BY count(*) DESC, role) AS rn FROM k GROUP BY 1, 2, 3, 4)
    SELECT lang, bucket, actor, name, kind, role FROM n JOIN d USING (lang, bucket, actor) JOIN r USING (lang, bucket, actor) WHERE n.rn = 1 AND d.rn = 1 AND r.rn = 1""",
)
def group_actors(spark: SparkSession, sf: str) -> DataFrame:
    rows = claims(spark, sf).where("source is not null")
    entity = F.struct(F.when(F.col("claim") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("name"), F.when(F.col("claim") % 3 == 0, "agency").otherwise("person").alias("kind"), F.col("hedging").alias("role"))
    return reduction.group_entities(rows.withColumn("entities", F.array(entity)), _G)


_SAID = [
    "No significant military claims were found.",
    "no relevant claims in the text",
    "No claims in this document",
    "No significant developments occurred along the axis",
    "There are no claims here",
    "  No notable claim was made",
    "No attacks are mentioned in the document.",
]


@query(
    "meta_claims",
    "SELECT conv_id, turn, regexp_matches(trim(s), '(?i)^no (significant|relevant|specific|notable)\\b.*\\bclaims?\\b') OR (regexp_matches(trim(s), '(?i)^no\\b') AND regexp_matches(trim(s), '(?i)\\bin (this|the) document\\b')) AS meta FROM "
    + f"(SELECT conv_id, turn, concat({picked_sql(_SAID, 'conv_id + turn')}, ' ', text) AS s FROM conversations WHERE text IS NOT NULL)",
)
def meta_claims(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(picked(_SAID, F.col("conv_id") + F.col("turn")), F.lit(" "), "text")
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", text.is_meta_claim(said).alias("meta"))


_NAMES = [("Moscow", "person"), ("Su-34", "person"), ("unnamed official", "person"), ("three men", "person"), ("Russian soldiers", "agency"), ("courts in Kyiv", "person"), ("Ivan Petrov", "person"), ("IRGC", "agency"), ("former mayor", "person")]


@query(
    "junk_names",
    f"""SELECT c_custkey, CASE WHEN lower(name) = 'irgc' THEN NULL WHEN lower(name) IN ('moscow', 'kyiv') THEN 'geography' WHEN regexp_matches(lower(name), '^(su|mig|tu|s|kh|fab|x)-\\d+\\w*$') THEN 'object'
      WHEN regexp_matches(lower(name), '^(unnamed|former)\\b') THEN 'unnamed' WHEN regexp_matches(lower(name), '^(three|\\d+)\\s') AND kind = 'person' THEN 'counted' WHEN regexp_matches(lower(name), '\\b(soldiers|courts)$') THEN 'collective'
      WHEN regexp_matches(lower(name), '\\s+in\\s+') AND kind <> 'agency' THEN 'descriptive' END AS reason
      FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_name WHEN c_custkey % 4 = 2 THEN concat({picked_sql([n for n, _ in _NAMES], 'c_custkey')}, ' in ', c_mktsegment) ELSE {picked_sql([n for n, _ in _NAMES], 'c_custkey')} END AS name, {picked_sql([k for _, k in _NAMES], 'c_custkey')} AS kind FROM customer)""",
)
def junk_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under their own names, under others, and under names with a place."""
    i = F.col("c_custkey")
    other = picked([n for n, _ in _NAMES], i)
    name = F.when(i % 4 == 3, F.col("c_name")).when(i % 4 == 2, F.concat(other, F.lit(" in "), "c_mktsegment")).otherwise(other)
    return table(spark, sf, "customer").select("c_custkey", names.junk_reason(name, picked([k for _, k in _NAMES], i), ["moscow", "kyiv"]).alias("reason"))
