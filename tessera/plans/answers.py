"""Queries on answers and what may be published: reranked and trimmed ids, related ones, coverage at publication, gates, guards, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, fidelity, retrieval
from ..functions import text
from ..session import table
from .registry import picked, picked_sql, query

_IDS_SQL = "a AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id) AS ids FROM events WHERE event_id % 5 <> 4 GROUP BY user_id), g AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS given FROM events WHERE event_id % 5 >= 3 GROUP BY user_id)"


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    ordered = lambda cond, *by: events.where(cond).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, "event_id"))), lambda x: x.getField("event_id")).alias("l"))
    ids = ordered("event_id % 5 <> 4", (-F.col("value")).alias("v")).withColumnRenamed("l", "ids")
    return ids.join(ordered("event_id % 5 >= 3", "ts").withColumnRenamed("l", "given"), "user_id")


@query(
    "reranked_ids",
    f"""
    WITH {_IDS_SQL}, v AS (SELECT user_id, ids, list_filter(given, lambda i: list_contains(ids, i)) AS valid FROM a JOIN g USING (user_id))
    SELECT user_id, list_slice(CASE WHEN len(valid) >= 10 THEN list_concat(valid, list_filter(ids, lambda i: NOT list_contains(valid, i))) ELSE ids END, 1, 20) AS first, len(list_slice(ids, 1, CASE WHEN user_id % 3 = 0 THEN len(ids) ELSE greatest(user_id % 15, 8) END)) AS trimmed FROM v""",
)
def reranked_ids(spark: SparkSession, sf: str) -> DataFrame:
    relevant = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 15).cast("int"))
    return _ids(spark, sf).select("user_id", answers.reranked(F.col("ids"), F.col("given"), 20).alias("first"), F.size(answers.trimmed(F.col("ids"), relevant)).cast("bigint").alias("trimmed"))


@query("related_ids", "SELECT event_id, value AS score FROM events WHERE value >= 50 AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 2 = 0) ORDER BY value DESC, event_id LIMIT 5")
def related_ids(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return answers.related(events.select("event_id", F.col("value").alias("score")), events.where("user_id % 2 = 0").select("event_id"), "event_id", "score", 50)


@query(
    "publish_coverage",
    """
    SELECT o_orderpriority AS digest, count(*) AS matched, count(*) FILTER (WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY) AS matched_before, CAST(100000 AS INTEGER) AS asked, round(100.0 * count(*) FILTER (WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY) / 100000, 1) AS coverage_pct
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def publish_coverage(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("digest"), (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(60))).alias("published"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("fetched")).join(orders, "l_orderkey")
    return answers.at_publish(rows, ["digest"], "fetched", "published", F.lit(100000))


@query(
    "eval_gate",
    """
    WITH m AS (SELECT event_id % 2 AS arm, round(100.0 * count(*) FILTER (WHERE value > CASE WHEN event_id % 2 = 0 THEN 60 ELSE 40 END) / count(*), 2) AS r, round(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*), 2) AS c, count(*) FILTER (WHERE value > 10) / count(*) AS h FROM events GROUP BY 1)
    SELECT round(b.r - a.r, 2) AS recall_delta, b.r - a.r >= 15 AS recall_pass, b.h >= 0.8 AS honesty_pass, b.c >= a.c AS citation_pass, b.r - a.r >= 15 AND b.h >= 0.8 AND b.c >= a.c AS passed FROM m a JOIN m b ON a.arm = 0 AND b.arm = 1""",
)
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    arm = F.col("event_id") % 2
    share = lambda c: F.count_if(c) / F.count("*")
    metrics = table(spark, sf, "events").groupBy(arm.alias("arm")).agg(
        F.round(100.0 * share(F.col("value") > F.when(arm == 0, 60).otherwise(40)), 2).cast("double").alias("recall_pct"), F.round(100.0 * share(F.col("event_type") == "click"), 2).cast("double").alias("citation_pct"), share(F.col("value") > 10).alias("honesty")
    )
    return answers.gate(metrics.where("arm = 0"), metrics.where("arm = 1"))


@query("configured_cells", "SELECT n_name AS country, unnest(CASE n_regionkey WHEN 0 THEN ['military'] WHEN 1 THEN ['military', 'elite'] ELSE ['military', 'elite', 'nuclear'] END) AS track FROM nation")
def configured_cells(spark: SparkSession, sf: str) -> DataFrame:
    lit = lambda *names: F.array(*[F.lit(n) for n in names])
    tracks = F.when(F.col("n_regionkey") == 0, lit("military")).when(F.col("n_regionkey") == 1, lit("military", "elite")).otherwise(lit("military", "elite", "nuclear"))
    return answers.cells(table(spark, sf, "nation").select(F.col("n_name").alias("country"), tracks.alias("tracks")))


@query(
    "rescore_refusals",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'not acknowledged' WHEN o_orderkey % 11 = 0 THEN 'no checkpoint' WHEN o_orderstatus <> 'F' THEN 'not complete' WHEN o_orderkey % 13 = 0 THEN 'invalid dates'
      WHEN DATE '1993-01-01' > CAST(o_orderdate AS DATE) OR DATE '1995-01-01' < CAST(o_orderdate AS DATE) + 3 THEN 'not covered' END AS refusal FROM orders""",
)
def rescore_refusals(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    complete = F.when(k % 11 != 0, F.col("o_orderstatus") == "F")
    date = lambda d: F.lit(d).cast("date")
    found = answers.refusal(k % 7 != 0, k % 5 != 0, complete, date("1993-01-01"), date("1995-01-01"), F.when(k % 13 != 0, day), F.date_add(day, 2))
    return table(spark, sf, "orders").select("o_orderkey", found.alias("refusal"))


_FOLLOWUPS = [
    ("What about Iran?", "talks in Tehran"), ("And Ukrainian losses?", "losses"), ("What happened yesterday?", "x"), ("Did Putin respond?", "putin spoke"), ("Did Lavrov respond?", "putin spoke"), ("What did it cost in May?", "cost"), ("What may follow?", "x"),
    ("Which Black Sea ports?", "ports of the black sea"), ("how many drones?", "drones"), ("", ""), ("Russia and Moscow?", "in moscow"), ("2024-05-01?", ""),
]


@query(
    "followup_scopes",
    f"WITH q AS (SELECT conv_id, turn, {picked_sql([q for q, _ in _FOLLOWUPS], 'conv_id + turn')} AS q, concat({picked_sql([e for _, e in _FOLLOWUPS], 'conv_id + turn')}, ' ', text) AS e, CASE WHEN conv_id % 2 = 0 THEN ['ru'] ELSE ['ua'] END AS t FROM conversations WHERE text IS NOT NULL), "
    "o AS (SELECT *, list_filter(list_transform(regexp_extract_all(q, '\\b[A-Z][a-z][\\p{L}''’-]+(?: [A-Z][\\p{L}''’-]+)?\\b'), lambda a: CASE WHEN list_contains(["
    + ", ".join(f"'{w}'" for w in answers.LEADING)
    + "], string_split(a, ' ')[1]) THEN CASE WHEN contains(a, ' ') THEN regexp_replace(a, '^\\S+ ', '') END ELSE a END), lambda a: a IS NOT NULL) AS own FROM q) SELECT conv_id, turn, CASE WHEN "
    + " OR ".join(f"(regexp_matches(q, '{p}') AND NOT list_contains(t, '{n}'))" for n, p in answers.THEATERS.items())
    + f" THEN 'new' WHEN regexp_matches(q, '{answers.TIMES}') OR len(list_filter(own, lambda a: NOT contains(lower(e), lower(a)))) > 0 THEN 'expand' ELSE 'reuse' END AS scope FROM o",
)
def followup_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that follow on turns of conversations, whose texts are what was found."""
    at = F.col("conv_id") + F.col("turn")
    found = F.concat(picked([e for _, e in _FOLLOWUPS], at), F.lit(" "), "text")
    theaters = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("ru"))).otherwise(F.array(F.lit("ua")))
    rows = table(spark, sf, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", answers.followup_scope(picked([q for q, _ in _FOLLOWUPS], at), theaters, found).alias("scope"))


_SAID = ["was arrested for fraud", "Sources say he was arrested", "he was arrested, officials said", "gave a speech", "allegedly took bribes", "died in hospital", "the court convicted him of treason", "a quiet day"]


def _at(pattern: str) -> str:
    """Where a pattern's first match starts; 0 without one."""
    return f"(CASE WHEN regexp_matches(s, '{pattern}') THEN strpos(s, regexp_extract(s, '{pattern}')) ELSE 0 END)"


@query(
    "guarded_events",
    f"""
    WITH c AS (SELECT doc_id // 3 AS event, doc_id AS claim, [{", ".join(f"'{s}'" for s in _SAID)}][CAST(1 + doc_id * 5 % {len(_SAID)} AS BIGINT)] AS s, ['confirmed', 'claimed', 'unverified', 'assessed'][CAST(1 + n_chars % 4 AS BIGINT)] AS hedging, 1 + doc_id % 3 AS documents, doc_id % 4 <> 1 AS person FROM documents),
    v AS (SELECT *, hedging IN ('claimed', 'unverified') AS disputed, hedging IN ('claimed', 'unverified') AND person AND regexp_matches(s, '{answers.ALLEGATION}') AS bad, CASE WHEN hedging = 'claimed' THEN 'Sources claim:' ELSE 'Unverified reporting:' END AS label,
      {_at(answers.ATTRIBUTED)} > 0 AND ({_at(answers.ALLEGATION)} = 0 OR {_at(answers.ATTRIBUTED)} < {_at(answers.ALLEGATION)}) AS governed FROM c),
    w AS (SELECT *, CASE WHEN bad AND regexp_matches(s, '{answers.REPUTATIONAL}') AND documents < 2 THEN 'drop' WHEN bad AND NOT governed THEN 'attribute' ELSE 'publish' END AS verdict FROM v),
    x AS (SELECT *, CASE WHEN verdict = 'attribute' THEN concat(label, ' ', s) ELSE s END AS said, CASE WHEN disputed AND NOT governed THEN concat(label, ' ', s) ELSE s END AS copy FROM w),
    e AS (SELECT event, list(claim ORDER BY claim) FILTER (WHERE verdict <> 'drop') AS claims, count(*) FILTER (WHERE verdict = 'drop') AS dropped, bool_or(bad) AS bad, bool_and(disputed) FILTER (WHERE verdict <> 'drop') AS open,
      bool_or(hedging = 'claimed' AND verdict <> 'drop') AS claimed, arg_max(copy, struct_pack(a := length(said), b := -claim)) FILTER (WHERE verdict <> 'drop') AS copy FROM x GROUP BY event),
    t AS (SELECT *, CASE WHEN event % 2 = 0 THEN 'A title' ELSE 'Officials said so' END AS title FROM e WHERE claims IS NOT NULL)
    SELECT event, CASE WHEN bad THEN copy WHEN open AND event % 2 = 0 THEN concat(CASE WHEN claimed THEN 'Sources claim:' ELSE 'Unverified reporting:' END, ' ', title) ELSE title END AS title, claims, dropped, CASE WHEN bad THEN 'rebuilt' WHEN open AND event % 2 = 0 THEN 'labelled' ELSE 'kept' END AS rule FROM t""",
)
def guarded_events(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), i.cast("int"))
    event = F.floor(d / 3).alias("event")
    docs = table(spark, sf, "documents")
    claims = docs.select(event, d.alias("claim"), pick(_SAID, d * 5 % len(_SAID)).alias("text"), pick(["confirmed", "claimed", "unverified", "assessed"], F.col("n_chars") % 4).alias("hedging"), (1 + d % 3).alias("documents"), (d % 4 != 1).alias("person"))
    titles = docs.select(event).distinct().select("event", F.when(F.col("event") % 2 == 0, "A title").otherwise("Officials said so").alias("title"))
    return answers.guarded(claims, titles)


@query(
    "hybrid_dated",
    """
    WITH v AS (SELECT vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(64), lambda i: CAST(((i * 37 + 11) % 64) - 31 AS DOUBLE))), 6) AS score FROM embeddings), w AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 150),
    k AS (SELECT doc_id AS id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%apache%'), u AS (SELECT coalesce(w.id, k.id) AS id, score, k.id IS NOT NULL AS lexical_hit FROM w FULL JOIN k ON w.id = k.id),
    m AS (SELECT u.*, CASE WHEN u.id % 4 <> 0 THEN DATE '2024-01-01' + CAST(u.id % 60 AS INTEGER) END AS day, CASE WHEN quality = 1 THEN 0.9e0 WHEN quality = 0 THEN 0.2e0 END AS conf FROM u LEFT JOIN labels ON u.id = labels.doc_id)
    SELECT id, lexical_hit, round(coalesce(score, 0.55) * CASE WHEN day IS NULL THEN 0.25 ELSE pow(0.5, greatest(date_diff('day', day, DATE '2024-02-15'), 0) / 30) END * (0.5 + 0.5 * coalesce(conf, 0.5)), 5) AS composite FROM m ORDER BY composite DESC, id LIMIT 300""",
)
def hybrid_dated(spark: SparkSession, sf: str) -> DataFrame:
    """Both arms, with dates and reliability: near and old rows, undated ones, and those that only words found."""
    from ..functions import scores

    probe = [float((i * 37 + 11) % 64 - 31) for i in range(64)]
    vector = retrieval.vector_arm(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding", probe, 150, "id")
    keyword = retrieval.keyword_arm(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"), ["license", "apache"])
    rel = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).alias("conf"))
    both = retrieval.union_arms(vector, keyword, "id", "score").join(rel, "id", "left")
    day = F.when(F.col("id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    composite = scores.composite(F.col("score"), day, F.col("conf"), F.lit("2024-02-15").cast("date"))
    return both.select("id", "lexical_hit", F.round(composite, 5).alias("composite")).orderBy(F.desc("composite"), "id").limit(300)


@query("claim_text_keys", "SELECT doc_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^\\p{L}\\p{N} ]', ' ', 'g'), ' +', ' ', 'g')), 1, 60) AS key FROM documents WHERE text IS NOT NULL")
def claim_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.prefix_key(F.col("text")).alias("key"))


_ANSWERED = [
    "Ivan Petrov was convicted [c1]. The Security Council met.", "According to reports, Ivan Petrov was arrested [c1][c2]. Ivan Petrov died.", "Aleksandr Novak is currently sanctioned [c2].", "Nikolai Orlov was killed [c1]. It rained [c2].",
    "Anna Weber was charged with fraud, according to reports [c2].", "Olga Smirnova spoke [c9]. Olga Smirnova spoke.", "Anna Weber is designated [c1][c2]. Wagner Group is there.", "No names here [c1].", "Ivan Petrov was confirmed dead [c2]!  He was 60.",
]
_CLAIMED = [
    "A court convicted Ivan Petrov in May.", "Ivan Petrov was arrested, sources say.", "Alexander Novak was delisted; sanctions were lifted.", "I. Petrov was not arrested [c7].", "Anna Weber, a possible match, is under sanctions", "Nikolai Orlov was killed near the front.",
    "The former deputy minister Anna Weber was designated.", "Officials confirmed the death of Ivan Petrov.",
]


def cited_turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as answers that end in their own texts, and two claims for each, which begin with other ones."""
    turns = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    key, n = F.concat_ws("/", "conv_id", "turn").alias("key"), F.col("conv_id") * 5 + F.col("turn")
    said = turns.select(key, F.concat(picked(_ANSWERED, n), F.lit(" "), "text").alias("answer"))
    claim = lambda i: F.struct(F.lit(i).cast("bigint").alias("claim"), F.concat("text", F.lit(" "), picked(_CLAIMED, n * i + F.length("text"))).alias("text"), picked(["claimed", "confirmed", "unverified"], n + i * F.col("turn")).alias("hedging"))
    claims = turns.select(key, F.explode(F.array(claim(1), claim(2))).alias("c")).select("key", "c.*")
    return said, claims


@query("faithful_answers")
def faithful_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers whose sentences on persons keep to what they cite, the others in the claims' words."""
    said, claims = cited_turns(spark, sf)
    return fidelity.faithful(said, claims, "key")
