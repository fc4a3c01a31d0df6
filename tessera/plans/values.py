"""Queries on functions of single values, and on steps of publication, over driver tables and literal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import days, gazetteer, identity, text
from ..operators import keyed, publishing, validation, votes
from ..session import table
from .registry import picked, picked_sql, query


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


_TOKENS = ["spring-2024", " Spring ", "", None, "a b", "x" * 120, "ok.~_-", "-no", "Ünï"]
_HOSTS = ["Example.com.", "sub.example.org", "a b", "x:80", "http://x", "", None, "-x.org", "localhost", "a" * 70 + ".org"]


@query(
    "strict_identities",
    "SELECT page_id, CASE WHEN regexp_matches(lower(trim(v)), '^[a-z0-9][a-z0-9._~-]*$') AND length(lower(trim(v))) <= 100 THEN lower(trim(v)) END AS campaign, "
    "CASE WHEN regexp_replace(lower(trim(v)), '\\.$', '') <> '' AND NOT regexp_matches(regexp_replace(lower(trim(v)), '\\.$', ''), '[\\s/@:?#]') AND length(regexp_replace(lower(trim(v)), '\\.$', '')) <= 253 "
    "AND regexp_matches(regexp_replace(lower(trim(v)), '\\.$', ''), '^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)*[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$') THEN regexp_replace(lower(trim(v)), '\\.$', '') END AS host FROM "
    + f"(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {picked_sql([*_TOKENS, *_HOSTS], 'page_id // 3')} WHEN page_id % 3 = 1 THEN concat(upper(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') ELSE url END AS v FROM pages)",
)
def strict_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Names of campaigns and hosts among pages' hosts, whole addresses and odd values."""
    i = F.col("page_id")
    host = F.concat(F.upper(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)), F.lit("."))
    v = F.when(i % 3 == 0, picked([*_TOKENS, *_HOSTS], F.floor(i / 3))).when(i % 3 == 1, host).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", identity.campaign(v).alias("campaign"), identity.host(v).alias("host"))


@query(
    "channel_keys",
    """
    SELECT page_id, coalesce(CASE WHEN page_id % 5 = 0 THEN concat('id:', page_id) END, 'unregistered:' || coalesce(nullif(lower(trim(CASE WHEN page_id % 5 = 1 THEN ' Key ' ELSE ' ' END)), ''),
      CASE WHEN regexp_matches(url, '^https?://[^/?#@]+') THEN regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) END), 'adapter:rss') AS channel FROM pages""",
)
def channel_keys(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.col("page_id")
    key = identity.channel(F.when(id_ % 5 == 0, id_), F.when(id_ % 5 == 1, " Key ").otherwise(" "), F.lit(None).cast("string"), F.col("url"), F.lit("RSS"))
    return table(spark, sf, "pages").select("page_id", key.alias("channel"))


@query(
    "shown_days",
    """
    SELECT event_id, CAST(ts AS DATE) AS utc_day, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS shown_day,
      CASE WHEN CAST(ts AS DATE) > CAST(ts - INTERVAL 20 HOUR AS DATE) THEN 'final' ELSE 'intraday' END AS stage,
      CASE WHEN event_id % 9 = 0 THEN 'none' WHEN CAST(ts - INTERVAL 20 HOUR AS DATE) >= CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) THEN 'today' ELSE 'previous' END AS status FROM events""",
)
def shown_days(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts")
    bucket = F.to_date(at - F.make_dt_interval(hours=F.lit(20)))
    return table(spark, sf, "events").select(
        "event_id", days.utc_day(at).alias("utc_day"), days.shown_day(at).alias("shown_day"), days.stage(bucket, at).alias("stage"), days.status(F.when(F.col("event_id") % 9 != 0, bucket), at).alias("status")
    )


@query(
    "day_ranges",
    "SELECT n_nationkey, len(range(DATE '2024-02-25', CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE DATE '2024-02-24' + n_nationkey END + 1, INTERVAL 1 DAY)) AS days FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey % 6 = 0",
)
def day_ranges(spark: SparkSession, sf: str) -> DataFrame:
    last = F.when(F.col("n_nationkey") % 6 != 0, F.date_add(F.lit("2024-02-24").cast("date"), F.col("n_nationkey")))
    return table(spark, sf, "nation").select("n_nationkey", F.size(days.day_range(F.lit("2024-02-25").cast("date"), last)).cast("bigint").alias("days"))


_STOP = ["the", "what", "did", "who", "and", "were", "has"]
_QUESTIONS = ["What did the navy say about Odesa and the Odesa port?", "Who?", "", "one-two three four five six seven eight nine ten eleven twelve", "Were drones, drones & missiles used?!"]

_ASKED_SQL = f"(SELECT conv_id, turn, concat({picked_sql(_QUESTIONS, 'conv_id + turn')}, ' ', text) AS q FROM conversations WHERE text IS NOT NULL)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as questions."""
    q = F.concat(picked(_QUESTIONS, F.col("conv_id") + F.col("turn")), F.lit(" "), "text")
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", q.alias("q"))


@query(
    "question_terms",
    "SELECT conv_id, turn, list_slice(list_distinct_ordered, 1, 8) AS terms FROM (SELECT conv_id, turn, list_transform(list_sort(list_transform(list_distinct(w), lambda x: struct_pack(i := list_position(w, x), w := x))), lambda s: s.w) AS list_distinct_ordered FROM "
    "(SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(q), '[^\\p{L}\\p{N}\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in _STOP)
    + f"], w)) AS w FROM {_ASKED_SQL}))",
)
def question_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("conv_id", "turn", text.question_terms(F.col("q"), _STOP).alias("terms"))


@query(
    "cache_keys",
    "SELECT conv_id, turn, sha256(CAST(to_json([regexp_replace(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), '[?.!]+$', ''), 'v2', CAST(turn AS VARCHAR)]) AS VARCHAR)) AS key FROM " + _ASKED_SQL,
)
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("conv_id", "turn", text.cache_key(F.col("q"), F.lit("v2"), F.col("turn")).alias("key"))


@query("display_names", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), nullif(trim(lang), ''), 'unknown') AS name FROM documents")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.display_name(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")), F.col("lang"), F.lit("unknown")).alias("name"))


@query(
    "magnitudes",
    "SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.1f', v / 1e9) || 'B' WHEN v >= 1e6 THEN printf('%.0f', v / 1e6) || 'M' ELSE printf('%.0f', v / 1e3) || 'K' END AS shown FROM (SELECT o_orderkey, o_totalprice * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END) AS v FROM orders)",
)
def magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 1000).otherwise(100000)
    return table(spark, sf, "orders").select("o_orderkey", text.magnitude(v).alias("shown"))


@query(
    "adjacent_jaccard",
    "WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT a.doc_id, a.s AS x, b.s AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1) "
    "SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similar FROM p",
)
def adjacent_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", words.alias("x"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id").select("doc_id", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("similar"))


# Places and actions ----------------------------------------------------------------------------------------------------

_PLACES = ["near Pokrovsk", "Купянск and Kharkiv", "in Moscow", "Donetsk region", "nowhere", "Crimea and Rostov", "Chasiv Yar"]
_ACTS = ["a drone strike", "troops advance", "ceasefire talks", "it rained", "losses grow"]


def _lexicon(lexicon: dict[str, list[str]], of: str) -> str:
    low = f"(' ' || lower({of}) || ' ')"
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join('contains(' + low + ', ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')' for p in parts)} THEN '{name}' END" for name, parts in lexicon.items()) + "], lambda x: x IS NOT NULL)"


def _listed(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _expanded(of: str) -> str:
    towns = " ".join(f"WHEN '{k}' THEN {_listed(v)}" for k, v in gazetteer.TOWNS.items())
    return f"list_distinct(list_concat({of}, flatten(list_transform({of}, lambda p: CASE p {towns} ELSE [] END))))"


_SIGNED_SQL = f"""
s AS (SELECT doc_id AS claim, concat({_listed(_PLACES)}[CAST(1 + doc_id % {len(_PLACES)} AS BIGINT)], ' ', {_listed(_ACTS)}[CAST(1 + doc_id % {len(_ACTS)} AS BIGINT)]) AS t, 1 + doc_id % 3 AS docs,
  CASE n_chars % 4 WHEN 0 THEN 'claimed' WHEN 1 THEN 'unverified' WHEN 2 THEN 'confirmed' ELSE 'assessed' END AS hedging, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id * 7 % 3000) AS earliest FROM documents),
c AS (SELECT *, {_lexicon(gazetteer.TOPONYMS, "t")} AS places, {_lexicon(gazetteer.ACTIONS, "t")} AS acts FROM s),
k AS (SELECT takeaway, {_lexicon(gazetteer.TOPONYMS, "t")} AS places, {_lexicon(gazetteer.ACTIONS, "t")} AS acts FROM
  (SELECT item_id AS takeaway, concat({_listed(_PLACES)}[CAST(1 + item_id * 3 % {len(_PLACES)} AS BIGINT)], ' ', {_listed(_ACTS)}[CAST(1 + item_id * 2 % {len(_ACTS)} AS BIGINT)]) AS t FROM benchmark)),
m AS (SELECT takeaway, claim, round(CASE WHEN sp > 0 THEN least(1.0, 0.5 + least(1.0, sp / 2) * 0.25 + CASE WHEN sa > 0 THEN 0.25 ELSE 0 END) WHEN sa > 0 THEN 0.25 ELSE 0 END, 4) AS score FROM
  (SELECT takeaway, claim, len(list_intersect(e, c.places)) AS sp, len(list_intersect(x.acts, c.acts)) AS sa FROM (SELECT *, {_expanded("places")} AS e FROM k) x, c)),
b AS (SELECT takeaway, claim, score FROM (SELECT *, row_number() OVER (PARTITION BY takeaway ORDER BY score DESC, claim) AS rn FROM m WHERE score >= 0.6) WHERE rn = 1)"""


def _signed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), (i % len(items)).cast("int"))
    signs = lambda df: df.withColumns({"places": gazetteer.toponyms(F.col("t")), "acts": gazetteer.actions(F.col("t"))})
    d, i, n = F.col("doc_id"), F.col("item_id"), F.col("n_chars") % 4
    claims = table(spark, sf, "documents").select(
        d.alias("claim"),
        F.concat(pick(_PLACES, d), F.lit(" "), pick(_ACTS, d)).alias("t"),
        (1 + d % 3).alias("docs"),
        F.when(n == 0, "claimed").when(n == 1, "unverified").when(n == 2, "confirmed").otherwise("assessed").alias("hedging"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(d * 7 % 3000).cast("int"))).alias("earliest"),
    )
    takeaways = table(spark, sf, "benchmark").select(i.alias("takeaway"), F.concat(pick(_PLACES, i * 3), F.lit(" "), pick(_ACTS, i * 2)).alias("t"))
    return signs(takeaways), signs(claims)


@query(
    "signatures",
    f"WITH {_SIGNED_SQL} SELECT claim, array_to_string(places, ',') AS places, array_to_string(acts, ',') AS acts, array_to_string(list_sort({_expanded('places')}), ',') AS expanded, "
    f"CASE WHEN list_has_any(places, {_listed(gazetteer.BOTH)}) OR list_has_any(places, {_listed(gazetteer.RUSSIAN)}) = (len(list_filter(places, lambda p: NOT list_contains({_listed([*gazetteer.RUSSIAN, *gazetteer.BOTH])}, p))) > 0) THEN 'both' "
    f"WHEN list_has_any(places, {_listed(gazetteer.RUSSIAN)}) THEN 'ru' ELSE 'ua' END AS side FROM c",
)
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    claims = _signed(spark, sf)[1]
    places = F.col("places")
    return claims.select("claim", F.array_join(places, ",").alias("places"), F.array_join("acts", ",").alias("acts"), F.array_join(F.sort_array(gazetteer.expanded(places)), ",").alias("expanded"), gazetteer.side(places).alias("side"))


@query("keyword_matches", f"WITH {_SIGNED_SQL} SELECT takeaway, claim, score FROM b")
def keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    return validation.keyword_matches(*_signed(spark, sf))


@query(
    "divergence_rows",
    f"""
    WITH {_SIGNED_SQL}
    SELECT CASE WHEN b.claim IS NULL THEN 'isw_only' ELSE 'agreement' END AS kind, k.takeaway, b.claim, round(b.score, 2) AS score, substring(c.t, 1, 200) AS text, CAST(NULL AS VARCHAR) AS hedging
    FROM k LEFT JOIN b USING (takeaway) LEFT JOIN c ON c.claim = b.claim WHERE len(k.places) > 0 OR len(k.acts) > 0
    UNION ALL SELECT 'ours_only', NULL, claim, NULL, substring(t, 1, 200), hedging FROM c WHERE (len(places) > 0 OR len(acts) > 0) AND claim NOT IN (SELECT claim FROM b)""",
)
def divergence_rows(spark: SparkSession, sf: str) -> DataFrame:
    takeaways, claims = _signed(spark, sf)
    return validation.divergences(takeaways, claims, validation.keyword_matches(takeaways, claims))


@query(
    "digest_score",
    f"""
    WITH {_SIGNED_SQL}, l AS (SELECT date_diff('microsecond', earliest, TIMESTAMP '2024-01-03 12:00:00') / 3.6e9 AS h FROM b JOIN c USING (claim))
    SELECT (SELECT count(*) FROM k WHERE len(places) + len(acts) > 0) AS takeaways, (SELECT count(*) FROM b) AS matched, round(100.0 * (SELECT count(*) FROM b) / (SELECT count(*) FROM k WHERE len(places) + len(acts) > 0), 1) AS coverage_pct,
      (SELECT round(count(*) FILTER (WHERE docs < 2 AND hedging IN ('claimed', 'unverified')) / count(*), 4) FROM c) AS thin_rate, (SELECT round(list_sort(list(h))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 1) FROM l) AS lead_hours,
      (SELECT count(*) FROM c WHERE len(places) + len(acts) > 0 AND claim NOT IN (SELECT claim FROM b)) AS ours_only""",
)
def digest_score(spark: SparkSession, sf: str) -> DataFrame:
    takeaways, claims = _signed(spark, sf)
    matches = validation.keyword_matches(takeaways, claims)
    return validation.digest_score(takeaways, claims, matches, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"))


# Steps of publication -----------------------------------------------------------------------------------------------------


@query(
    "swapped_digests",
    """
    WITH o AS (SELECT source AS k, count(*) AS events FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT source AS k, count(*) FILTER (WHERE doc_id % 5 <> 0 AND source NOT IN ('src3', 'src4') AND (source <> 'src5' OR doc_id % 10 = 1)) AS events FROM documents WHERE doc_id % 2 = 1 AND source <> 'src6' GROUP BY 1),
    b AS (SELECT coalesce(o.k, n.k) AS k, o.events AS oe, n.events AS ne FROM o FULL JOIN n ON o.k = n.k), d AS (SELECT *, CASE WHEN ne IS NULL THEN 'kept' WHEN ne = 0 AND coalesce(oe, 0) > 0 THEN 'refused_empty' WHEN ne < 0.5 * coalesce(oe, 0) THEN 'refused_thin' ELSE 'written' END AS decision FROM b)
    SELECT k, CASE WHEN decision = 'written' THEN ne ELSE oe END AS events, decision FROM d WHERE k IS NOT NULL""",
)
def swapped_digests(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("k"), "doc_id")
    old = docs.where("doc_id % 2 = 0").groupBy("k").agg(F.count("*").alias("events"))
    some = (F.col("doc_id") % 5 != 0) & ~F.col("k").isin("src3", "src4") & ((F.col("k") != "src5") | (F.col("doc_id") % 10 == 1))
    new = docs.where("doc_id % 2 = 1 and k <> 'src6'").groupBy("k").agg(F.count_if(some).alias("events"))
    return publishing.swapped(old, new, "k")


@query(
    "cited_answers",
    """
    WITH r AS (SELECT lang, doc_id, substring(text, 1, 60) AS t, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS i FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)
    SELECT lang, concat('Top matching evidence:', chr(10), string_agg(concat('• ', t, ' [c', doc_id, ']'), chr(10) ORDER BY i)) AS answer, list(doc_id ORDER BY i) AS cited FROM r WHERE i <= 6 GROUP BY lang""",
)
def cited_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("lang is not null and text is not null").select("lang", F.col("doc_id").alias("claim"), F.substring("text", 1, 60).alias("text"), "n_chars")
    return publishing.answer(rows, "lang", [F.desc_nulls_last("n_chars"), F.col("claim")])


@query(
    "evidence_lines",
    """
    SELECT doc_id, concat('[c', doc_id, '] (', coalesce(lang, 'xx'), '/', coalesce(CASE WHEN doc_id % 2 = 0 THEN 'military' END, '-'), ', ', coalesce(CAST(CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-01-05' END AS VARCHAR), 'undated'), ', claimed, reliability ',
      CASE WHEN quality IS NULL THEN '?' ELSE printf('%.2f', quality * 0.5 + 0.25) END, ', entities: ', coalesce(source, ''), ') ', substring(text, 1, 30)) AS line FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL""",
)
def evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    id_ = F.col("doc_id")
    line = publishing.evidence_line(
        id_,
        F.coalesce("lang", F.lit("xx")),
        F.when(id_ % 2 == 0, "military"),
        F.when(id_ % 3 != 0, F.lit("2024-01-05").cast("date")),
        F.lit("claimed"),
        F.col("quality") * 0.5 + 0.25,
        F.array_compact(F.array("source")),
        F.substring("text", 1, 30),
    )
    return rows.select("doc_id", line.alias("line"))


@query(
    "billing_units",
    """
    WITH r AS (SELECT doc_id, ['answered', 'error', 'refused', 'answered', 'limit'][CAST(1 + doc_id % 5 AS BIGINT)] AS state, ['openai', 'stub', 'openai'][CAST(1 + n_chars % 3 AS BIGINT)] AS provider, CASE WHEN doc_id // 5 % 3 = 0 THEN 'exact' END AS cache,
      source = 'src7' AS replayed, CASE WHEN lang = 'en' THEN 'deep' ELSE 'auto' END AS mode FROM documents)
    SELECT doc_id, CASE WHEN replayed THEN 0 WHEN cache = 'exact' THEN 0 WHEN state IN ('limit', 'error') OR provider IN ('stub', 'budget') THEN 0 WHEN mode = 'deep' THEN 3 ELSE 1 END AS units,
      CASE WHEN replayed OR cache = 'exact' OR state IN ('limit', 'error') OR provider IN ('stub', 'budget') THEN false ELSE mode = 'deep' END AS billable FROM r""",
)
def billing_units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answered questions, by states, providers, cached and replayed answers."""
    i = F.col("doc_id")
    mode = F.when(F.col("lang") == "en", "deep").otherwise("auto")
    of = (picked(["answered", "error", "refused", "answered", "limit"], i), picked(["openai", "stub", "openai"], F.col("n_chars")), F.when(F.floor(i / 5) % 3 == 0, "exact"), F.col("source") == "src7", mode)
    units = publishing.units(*of)
    enforced, at = F.when(mode == "deep", "enforce").otherwise("shadow"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "documents").select("doc_id", units.alias("units"), publishing.billable(units, enforced, at, at).alias("billable"))


_KINDS = ["run.created", "retrieval.lexical_partial", "retrieval.completed", "answer.started", "run.completed", "run.failed", "other"]


@query(
    "run_views",
    f"""
    WITH e AS (SELECT user_id AS run, event_id AS seq, {_listed(_KINDS)}[CAST(1 + (event_id * 31 + user_id) % CASE WHEN user_id % 3 = 0 THEN 7 ELSE 4 END AS BIGINT)] AS event FROM events),
    r AS (SELECT run, max(seq) AS last_seq, max(CASE event WHEN 'run.created' THEN 0 WHEN 'retrieval.lexical_partial' THEN 1 WHEN 'retrieval.completed' THEN 2 WHEN 'answer.started' THEN 3 WHEN 'run.completed' THEN 4 WHEN 'run.failed' THEN 4 END) AS p,
      arg_min(event, seq) FILTER (WHERE event IN ('run.completed', 'run.failed')) AS e FROM e GROUP BY run)
    SELECT run, last_seq, CASE WHEN e = 'run.failed' THEN 'failed' ELSE ['starting', 'retrieving', 'selecting', 'answering', 'done'][1 + coalesce(p, 0)] END AS phase FROM r""",
)
def run_views(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((e * 31 + u) % F.when(u % 3 == 0, 7).otherwise(4)).cast("int"))
    return publishing.run_views(table(spark, sf, "events").select(u.alias("run"), e.alias("seq"), kind.alias("event")), "run")


@query(
    "new_ownership",
    """
    WITH l AS (SELECT l_suppkey AS owner, l_partkey % 100 + 1 AS owned, CASE l_returnflag WHEN 'N' THEN 'stub' WHEN 'R' THEN 'register' ELSE 'house' END AS source FROM lineitem), k AS (SELECT DISTINCT owner, owned FROM l WHERE source = 'house' AND owned % 2 = 0)
    SELECT DISTINCT owner, owned, source FROM l WHERE source <> 'stub' AND owner <> owned AND NOT EXISTS (SELECT 1 FROM k WHERE k.owner = l.owner AND k.owned = l.owned)""",
)
def new_ownership(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 100 + 1).alias("owned"), F.when(flag == "N", "stub").when(flag == "R", "register").otherwise("house").alias("source"))
    return publishing.ownership_edges(links, links.where("source = 'house' and owned % 2 = 0").select("owner", "owned").distinct())


@query(
    "screened_names",
    """
    WITH g AS (SELECT user_id, list(struct_pack(m := value > 70, t := CASE WHEN event_type = 'error' THEN 'sanction' ELSE 'crime' END, id := event_id, s := value) ORDER BY event_id) AS r FROM events GROUP BY user_id),
    a AS (SELECT user_id, list_filter(r, lambda x: x.m)[1] AS h, r[1] AS f FROM g)
    SELECT user_id, h IS NOT NULL AS matched, coalesce(h.t = 'sanction', false) AS sanctioned, CAST(h.id AS VARCHAR) AS id, coalesce(h.s, 0.0) AS score, CASE WHEN h IS NULL THEN CAST(f.id AS VARCHAR) END AS rejected FROM a""",
)
def screened_names(spark: SparkSession, sf: str) -> DataFrame:
    topics = F.array(F.when(F.col("event_type") == "error", "sanction").otherwise("crime"))
    id_ = F.col("event_id").cast("string")
    result = F.struct("event_id", (F.col("value") > 70).alias("match"), topics.alias("topics"), id_.alias("id"), F.col("value").alias("score"), id_.alias("caption"))
    found = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    return found.select("user_id", publishing.screened(F.col("results")).alias("s")).select("user_id", "s.*")


@query(
    "finalised_claims",
    """
    WITH g AS (SELECT doc_id AS g, CASE WHEN doc_id % 4 = 0 THEN 'assessment' ELSE 'factual' END AS claim_type, ['confirmed', 'claimed', 'unverified', 'assessed', 'unknown'][CAST(1 + n_chars % 5 AS BIGINT)] AS h, doc_id % 3 = 0 AS promoted FROM documents),
    c AS (SELECT doc_id AS g, source AS event, doc_id // 7 AS claim, doc_id // 7 % 2 = 0 AS bad FROM documents WHERE source IS NOT NULL),
    a AS (SELECT event, claim, bool_and(claim_type = 'assessment') AS every, min(list_position(['confirmed', 'claimed', 'unverified', 'unknown'], h)) AS x, min(list_position(['confirmed', 'claimed', 'unverified', 'unknown'], CASE WHEN promoted THEN 'claimed' ELSE h END)) AS y, bool_or(bad) AS bad, list_sort(list(g)) AS docs
      FROM c JOIN g USING (g) GROUP BY 1, 2)
    SELECT event, claim, 'claim' AS text, CASE WHEN every THEN 'assessment' ELSE 'factual' END AS claim_type, CASE WHEN every THEN 'assessed' ELSE coalesce(['confirmed', 'claimed', 'unverified', 'unknown'][CASE WHEN x = 1 AND bad THEN y ELSE x END], 'unknown') END AS hedging, docs FROM a""",
)
def finalised_claims(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    hedging = F.get(F.array(*[F.lit(h) for h in text.HEDGING_LADDER]), (F.col("n_chars") % 5).cast("int"))
    groups = docs.select(d.alias("group"), F.when(d % 4 == 0, "assessment").otherwise("factual").alias("claim_type"), hedging.alias("hedging"), (d % 3 == 0).alias("promoted"), F.array(d).alias("docs"))
    claim = F.floor(d / 7)
    claims = docs.where("source is not null").select(F.col("source").alias("event"), claim.alias("claim"), F.lit("claim").alias("text"), d.alias("group"), (claim % 2 == 0).alias("bad"))
    return publishing.finalised(claims, groups, F.col("bad"))


@query(
    "compacted_history",
    """
    WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM conversations WHERE text IS NOT NULL AND role = 'user')
    SELECT conv_id, concat(string_agg(concat('T', turn, ': Q: ', substring(text, 1, 200), ' → answered', CASE WHEN turn > 0 THEN concat(' [cited: ', turn, ',', turn + 1, ']') ELSE '' END), chr(10) ORDER BY turn, text),
      chr(10), 'T', max(turn), ' answer: ', substring(arg_min(text, back), 1, 1200)) AS history FROM t GROUP BY conv_id""",
)
def compacted_history(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("text is not null and role = 'user'")
    cited = F.when(F.col("turn") > 0, F.array("turn", F.col("turn") + 1)).otherwise(F.array().cast("array<bigint>"))
    return publishing.compacted(turns.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("question"), F.lit("answered").alias("state"), cited.alias("cited"), F.col("text").alias("answer")), "conv_id")


@query(
    "leases",
    """
    WITH s AS (SELECT user_id AS k, CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('o', user_id % 3) END AS owner, TIMESTAMP '2024-01-03' + INTERVAL 1 HOUR * (user_id % 100) AS expires FROM events WHERE event_id % 10 = 1 GROUP BY user_id),
    a AS (SELECT user_id AS k, concat('o', event_id % 3) AS w, ts AS t, ts + INTERVAL 1 HOUR AS until, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
    b AS (SELECT coalesce(s.k, a.k) AS k, owner, expires, w, t, until, w IS NOT NULL AND (owner IS NULL OR owner = w OR expires <= t) AS taken FROM s FULL JOIN (SELECT * FROM a WHERE rn = 1) a ON s.k = a.k)
    SELECT k, CASE WHEN taken THEN w ELSE owner END AS owner, CASE WHEN taken THEN until ELSE expires END AS expires, taken FROM b""",
)
def leases(spark: SparkSession, sf: str) -> DataFrame:
    events, u = table(spark, sf, "events"), F.col("user_id")
    state = events.where("event_id % 10 = 1").select(u.alias("k")).distinct()
    expires = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("k") % 100).cast("int"))
    state = state.select("k", F.when(F.col("k") % 4 != 0, F.concat(F.lit("o"), (F.col("k") % 3).cast("string"))).alias("owner"), expires.alias("expires"))
    tries = events.where("event_type = 'error'").select(u.alias("k"), F.concat(F.lit("o"), (F.col("event_id") % 3).cast("string")).alias("owner"), F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("until"), "event_id")
    return keyed.compare_and_set(state, tries, "k", ["at", "event_id"])


@query(
    "advanced_marks",
    "WITH m AS (SELECT source AS k, max(doc_id) AS mark FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL GROUP BY 1), p AS (SELECT source AS k, max(doc_id) AS mark FROM documents WHERE doc_id % 2 = 1 AND source IS NOT NULL GROUP BY 1) SELECT k, greatest(coalesce(m.mark, p.mark), coalesce(p.mark, m.mark)) AS mark FROM m FULL JOIN p USING (k)",
)
def advanced_marks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("source is not null")
    mark = lambda rest: docs.where(F.col("doc_id") % 2 == rest).groupBy(F.col("source").alias("k")).agg(F.max("doc_id").alias("mark"))
    return keyed.advanced(mark(0), mark(1), "k", "mark")


_LEDGER = ["reserved", "started", "settled", "released"]


@query(
    "settled_ledgers",
    f"""
    WITH RECURSIVE e AS (SELECT user_id AS k, ts, {_listed(_LEDGER)}[CAST(1 + (event_id * 7 + user_id) % 4 AS BIGINT)] AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT k, n, CASE WHEN s = 'reserved' THEN s END AS now, CASE WHEN s = 'reserved' THEN ts END AS t FROM e WHERE n = 1
      UNION ALL SELECT e.k, e.n, CASE WHEN ok THEN e.s ELSE now END, CASE WHEN ok THEN e.ts ELSE t END FROM (SELECT f.*, e.n AS m, (now IS NULL AND e.s = 'reserved') OR coalesce((e.s = 'started' AND now = 'reserved') OR (e.s = 'settled' AND now = 'started') OR (e.s = 'released' AND now IN ('reserved', 'started')), false) AS ok
        FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1) f JOIN e ON e.k = f.k AND e.n = f.m)
    SELECT k, CASE WHEN now = 'reserved' AND t < TIMESTAMP '2024-01-10' - INTERVAL 7 DAY THEN 'expired' ELSE now END AS state FROM f WHERE n = (SELECT max(n) FROM e WHERE e.k = f.k)""",
)
def settled_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(x) for x in _LEDGER]), ((F.col("event_id") * 7 + F.col("user_id")) % 4).cast("int"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), "ts", kind.alias("state"))
    steps = {"started": ("reserved",), "settled": ("started",), "released": ("reserved", "started")}
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return keyed.settled(rows, "k", "state", "ts", as_of, F.make_dt_interval(days=F.lit(7)), steps, "reserved")


def vote_events(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as events of five runs: twelve places each, with claims about ids of their place, of which some are left out."""
    i = F.col("doc_id")
    place = F.floor(F.pmod(i, F.lit(60)) / 5).cast("int")
    ids = lambda least, most: F.filter(F.sequence(10 * place + least, 10 * place + most), lambda k: (i * 7 + k) % 5 != 0)
    claim = lambda text, ids: F.struct(F.coalesce(text, F.lit("")).alias("text"), F.transform(ids, lambda k: k.cast("bigint")).alias("ids"))
    halves = F.array(claim(F.col("text"), ids(0, 3)), claim(F.col("source"), ids(4, 6)))
    return table(spark, sf, "documents").select(F.floor(i / 60).alias("cell"), (i % 5).cast("int").alias("vote"), place.alias("place"), F.concat(F.lit("event "), i).alias("title"), F.coalesce("lang", F.lit("none")).alias("kind"), halves.alias("claims"))


@query("merged_votes")
def merged_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Events that most of five runs have, with whole texts as claims, whose lengths name the middle event."""
    events = vote_events(spark, sf)
    found = votes.merged_votes(events, "cell", events.select("cell").distinct().withColumn("runs", F.lit(5)))
    return found.select("cell", "place", "title", "kind", "votes", F.round("mean_rank", 6).alias("mean_rank"), "ids", F.transform("claims", lambda c: c.getField("ids")).alias("claim_ids"))
