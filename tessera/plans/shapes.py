"""Relational shapes that are built at run time or rarely met: optional filters, guards, neighbours, repeated runs, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import keyed, sampling, selection
from ..session import table
from .registry import query


@query("optional_filters", "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src1' AND text ILIKE '%license%' AND n_chars > 0")
def optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = selection.matching(docs, selection.equals("source", "src1"), selection.equals("lang", None), selection.contains("text", "license"), F.col("n_chars") > 0)
    return found.select("doc_id", "source", "n_chars")


@query(
    "optional_scalar",
    "SELECT 'all' AS arm, source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'en', source, count(*) FROM documents WHERE lang = 'en' GROUP BY source",
)
def optional_scalar(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "lang")
    count = lambda lang: selection.matching(docs, selection.equals("lang", lang)).groupBy("source").agg(F.count("*").alias("n")).select(F.lit(lang or "all").alias("arm"), "source", "n")
    return count(None).unionByName(count("en"))


_LAST_ORDER = "SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"


@query(
    "dated_window",
    f"""
    WITH d AS ({_LAST_ORDER})
    SELECT 'both' AS w, count(*) AS n FROM d WHERE last >= DATE '1998-01-01' AND last <= DATE '1998-06-30' UNION ALL SELECT 'from', count(*) FROM d WHERE last >= DATE '1998-01-01'
    UNION ALL SELECT 'none', count(*) FROM d""",
)
def dated_window(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    dated = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    windows = {"both": ("1998-01-01", "1998-06-30"), "from": ("1998-01-01", None), "none": (None, None)}
    counts = [F.count_if(F.lit(True) if (c := selection.in_window("last", *w)) is None else c).alias(k) for k, w in windows.items()]
    return dated.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(k).alias("w"), F.col(k).alias("n")) for k in windows])))


@query("role_projection", "SELECT 'member' AS seen_by, c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 'guest', c_custkey, c_name, NULL FROM customer")
def role_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    seen = lambda who: selection.visible(rows, ["c_acctbal"], who == "member").withColumn("seen_by", F.lit(who))
    return seen("member").unionByName(seen("guest"), allowMissingColumns=True)


@query("public_projection", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Records without their texts, with how many they hold."""
    records = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("said"))
    return records.select("conv_id", F.size("said").cast("bigint").alias("turns"), F.size(F.array_distinct("said")).cast("bigint").alias("roles"))


@query(
    "rolling_membership",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS t, CAST(ts AS DATE) AS day FROM events)
    SELECT event_id FROM e WHERE coalesce(t >= TIMESTAMP '2024-01-09 06:00:00' AND t < TIMESTAMP '2024-01-10 06:00:00', day = DATE '2024-01-09')""",
)
def rolling_membership(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("at"), F.to_date("ts").alias("day"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    inside = selection.on_day(F.col("at"), F.col("day"), at("2024-01-09 06:00:00"), at("2024-01-10 06:00:00"), F.lit("2024-01-09").cast("date"))
    return events.where(inside).select("event_id")


@query(
    "existence_checks",
    "SELECT EXISTS(SELECT 1 FROM labels WHERE toxic = 1) AS toxic, EXISTS(SELECT 1 FROM documents WHERE lang = 'xx') AS other_lang, EXISTS(SELECT 1 FROM documents WHERE text IS NULL UNION ALL SELECT 1 FROM benchmark WHERE text IS NULL) AS no_text",
)
def existence_checks(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    arms = {
        "toxic": table(spark, sf, "labels").where("toxic = 1").select("doc_id"),
        "other_lang": docs.where("lang = 'xx'").select("doc_id"),
        "no_text": docs.where("text is null").select("doc_id").unionByName(bench.where("text is null").select(F.col("item_id").alias("doc_id"))),
    }
    rows = None
    for name, arm in arms.items():
        one = selection.exists(arm, "there").select(F.lit(name).alias("name"), "there")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.bool_or(F.when(F.col("name") == n, F.col("there"))).alias(n) for n in arms])


@query("long_unmarked", "SELECT doc_id, length(text) AS size FROM documents WHERE length(text) >= 40 AND text NOT LIKE 'Th%'")
def long_unmarked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.length("text") >= 40) & ~F.col("text").startswith("Th")).select("doc_id", F.length("text").cast("bigint").alias("size"))


@query(
    "coalesced_day",
    """
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE coalesce(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END, o_orderdate) >= TIMESTAMP '1996-03-01' AND coalesce(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END, o_orderdate) < TIMESTAMP '1996-03-02'""",
)
def coalesced_day(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a day by the first known of two times, as a half-open range on the times themselves."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.coalesce(F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")), "o_orderdate")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return items.where((at >= day("1996-03-01")) & (at < day("1996-03-02"))).select("l_orderkey", "l_linenumber")


_K = "json_extract_string(props, '$.k')"


@query(
    "guarded_cast",
    f"""
    SELECT event_type, CASE WHEN {_K} IS NULL THEN -1 WHEN NOT regexp_matches({_K}, '^[0-9]+$') THEN -2 WHEN CAST({_K} AS BIGINT) > 50 THEN 1 ELSE 0 END AS class, count(*) AS n FROM events GROUP BY 1, 2""",
)
def guarded_cast(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered CASE whose second branch keeps the cast of the third from failing."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(k.isNull(), -1).when(~k.rlike("^[0-9]+$"), -2).when(k.try_cast("bigint") > 50, 1).otherwise(0)
    return table(spark, sf, "events").groupBy("event_type", kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "json_flags",
    """
    WITH j AS (SELECT event_id, concat('{"', event_type, '": ', CASE WHEN value > 50 THEN 'true' ELSE 'false' END, '}') AS j FROM events)
    SELECT count(*) FILTER (WHERE json_exists(j, '$.error')) AS has_error, count(*) FILTER (WHERE json_extract_string(j, '$.error') = 'true') AS error_true,
      count(*) FILTER (WHERE json_exists(j, '$.click') AND coalesce(json_extract_string(j, '$.click'), 'false') <> 'true') AS click_not_true FROM j""",
)
def json_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a key is there, and whether its boolean is true."""
    made = F.concat(F.lit('{"'), "event_type", F.lit('": '), F.when(F.col("value") > 50, "true").otherwise("false"), F.lit("}"))
    keys = F.from_json(made, "map<string, string>")
    has = lambda k: F.map_contains_key(keys, k)
    true = lambda k: F.coalesce(F.get_json_object(made, f"$.{k}").try_cast("boolean"), F.lit(False))
    return table(spark, sf, "events").agg(F.count_if(has("error")).alias("has_error"), F.count_if(true("error")).alias("error_true"), F.count_if(has("click") & ~true("click")).alias("click_not_true"))


@query(
    "completed_work",
    """
    SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'N' AND d.l_partkey = l.l_partkey AND d.l_suppkey = l.l_suppkey AND d.l_linestatus = l.l_linestatus)""",
)
def completed_work(spark: SparkSession, sf: str) -> DataFrame:
    """Work that isn't done yet: an anti join on three keys."""
    items = table(spark, sf, "lineitem")
    done = items.where("l_returnflag = 'N'").select("l_partkey", "l_suppkey", "l_linestatus").distinct()
    return items.join(done, ["l_partkey", "l_suppkey", "l_linestatus"], "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "label_pairs",
    """
    WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)
    SELECT a.conv_id, a.turn AS left_turn, b.turn AS right_turn, a.i AS left_i, b.i AS right_i FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.i < b.i AND a.role <> b.role WHERE a.i <= 12 AND b.i <= 12""",
)
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a digest's events (the first twelve, as a digest has no more) that are different ones."""
    turns = keyed.top_per_group(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 12, "i").select("conv_id", "turn", "role", F.col("i").cast("bigint").alias("i"))
    side = lambda s: turns.select("conv_id", F.col("turn").alias(f"{s}_turn"), F.col("role").alias(f"{s}_role"), F.col("i").alias(f"{s}_i"))
    pairs = side("left").join(side("right"), "conv_id").where("left_i < right_i and left_role <> right_role")
    return pairs.select("conv_id", "left_turn", "right_turn", "left_i", "right_i")


@query(
    "three_way_inner",
    "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(c_name) = lower('CUSTOMER#000000007') OR c_custkey % 100 = 3",
)
def three_way_inner(spark: SparkSession, sf: str) -> DataFrame:
    who = table(spark, sf, "customer").where("lower(c_name) = 'customer#000000007' or c_custkey % 100 = 3")
    joined = who.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_name", "n_name", "r_name")


@query(
    "update_from",
    """
    WITH n AS (SELECT l_suppkey AS s_suppkey, count(*) AS lines, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1)
    SELECT s_suppkey, coalesce(lines, 0) AS lines, coalesce(last, TIMESTAMP '1990-01-01') AS last FROM supplier LEFT JOIN n USING (s_suppkey)""",
)
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension's columns from a fact's aggregates; rows that no fact has keep theirs."""
    dim = table(spark, sf, "supplier").select("s_suppkey", F.lit(0).cast("bigint").alias("lines"), F.lit("1990-01-01").cast("timestamp_ntz").alias("last"))
    facts = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last"))
    return keyed.upsert(dim, facts, ["s_suppkey"], keep_old=True)


@query(
    "get_or_create",
    """
    WITH d AS (SELECT DISTINCT source AS name FROM documents WHERE doc_id % 3 = 0), o AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM d),
    k AS (SELECT DISTINCT concat(source, '/', lang) AS name FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL), f AS (SELECT name FROM k WHERE name NOT IN (SELECT name FROM d))
    SELECT name, id FROM o WHERE name IN (SELECT name FROM k) UNION ALL SELECT name, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name) FROM f""",
)
def get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    known = sampling.numbered(docs.where("doc_id % 3 = 0").select(F.col("source").alias("name")).distinct(), "name", "id", 1)
    keys = docs.where("source is not null").select(F.concat("source", F.lit("/"), "lang").alias("name")).unionByName(docs.select(F.col("source").alias("name"))).where("name is not null")
    return sampling.get_or_create(known, keys, "name", "id")


@query(
    "next_slot",
    "SELECT conv_id, max(turn) + 1 AS slot FROM conversations GROUP BY conv_id HAVING max(turn) + 1 < 4 UNION ALL SELECT -1, max(turn) + 1 FROM conversations HAVING max(turn) + 1 < 2",
)
def next_slot(spark: SparkSession, sf: str) -> DataFrame:
    """The next number where there is room; the aggregate over all rows gives none where there isn't."""
    turns = table(spark, sf, "conversations")
    each = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("slot")).where("slot < 4")
    return each.unionByName(turns.agg(F.lit(-1).cast("bigint").alias("conv_id"), (F.max("turn") + 1).alias("slot")).where("slot < 2"))


@query(
    "earliest_evidence",
    "SELECT l_orderkey, min(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END, o_orderdate)) AS earliest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
)
def earliest_evidence(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    items = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("shipped")).join(orders, "l_orderkey")
    return items.groupBy("l_orderkey").agg(F.min(F.coalesce("shipped", "o_orderdate")).alias("earliest"))


@query(
    "eval_full",
    """
    SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS questions, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase' AND value > 20) / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 1) AS recall_pct,
      round(100.0 * count(*) FILTER (WHERE event_type = 'error' AND value <= 50) / nullif(count(*) FILTER (WHERE event_type = 'error'), 0), 1) AS honesty_pct, round(avg(value), 4) AS mean_latency, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 2) AS cost,
      count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09') AS window_ok, round(100.0 * count(*) FILTER (WHERE value > 1e9) / nullif(count(*) FILTER (WHERE event_type = 'none'), 0), 1) AS undefined_pct FROM events GROUP BY 1""",
)
def eval_full(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation's metrics in one pass; a ratio of nothing is null."""
    kind, value = F.col("event_type"), F.col("value")
    share = lambda hit, of: F.round(F.try_divide(F.count_if(of & hit) * 100.0, F.count_if(of)), 1).cast("double")
    day = F.to_date("ts")
    return (
        table(spark, sf, "events")
        .groupBy(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"))
        .agg(
            F.count("*").alias("questions"),
            share(value > 20, kind == "purchase").alias("recall_pct"),
            share(value <= 50, kind == "error").alias("honesty_pct"),
            F.round(F.avg("value"), 4).alias("mean_latency"),
            F.round(F.sum(F.round(value * 100).cast("bigint")) / 100.0, 2).alias("cost"),
            F.count_if((day >= F.lit("2024-01-05").cast("date")) & (day <= F.lit("2024-01-09").cast("date"))).alias("window_ok"),
            share(value > 1e9, kind == "none").alias("undefined_pct"),
        )
    )


@query(
    "arm_gates",
    """
    WITH c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS arm, user_id AS cell, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS runs FROM events GROUP BY 1, 2),
    a AS (SELECT arm, round(avg(mean), 4) AS mean, round(avg(sd) FILTER (WHERE runs >= 2), 4) AS within_sd, count(*) AS cells FROM c GROUP BY arm)
    SELECT n.mean AS new_mean, o.mean AS old_mean, n.within_sd AS new_sd, o.within_sd AS old_sd, n.mean >= o.mean AS mean_ok, n.within_sd <= o.within_sd AS sd_ok, n.mean >= o.mean AND n.within_sd <= o.within_sd AS passed FROM a n JOIN a o ON n.arm = 'new' AND o.arm = 'old'""",
)
def arm_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, then arms, then whether the new arm passes."""
    arm = F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("arm")
    cells = table(spark, sf, "events").groupBy(arm, "user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("runs"))
    of = lambda which, column: F.round(F.avg(F.when((F.col("arm") == which) & F.lit(True), F.col(column))), 4)
    one = cells.agg(of("new", "mean").alias("new_mean"), of("old", "mean").alias("old_mean"), of("new", "sd").alias("new_sd"), of("old", "sd").alias("old_sd"))
    better, steadier = F.col("new_mean") >= F.col("old_mean"), F.col("new_sd") <= F.col("old_sd")
    return one.select("*", better.alias("mean_ok"), steadier.alias("sd_ok"), (better & steadier).alias("passed"))


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower(line), '[^a-z]+'), lambda w: w <> ''))"


@query(
    "reproducibility",
    f"""
    WITH l AS (SELECT conv_id, turn AS run, line, {_WORDS_SQL} AS s FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'user')),
    u AS (SELECT DISTINCT conv_id, run, list_sort(s) AS s FROM l WHERE len(s) > 0), r AS (SELECT conv_id, run, count(*) AS n FROM u GROUP BY 1, 2),
    p AS (SELECT a.conv_id, a.run AS x, b.run AS y, a.n FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.run <> b.run),
    m AS (SELECT a.conv_id, a.run AS x, b.run AS y, count(DISTINCT a.s) AS hit FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.run <> b.run
      WHERE 2 * len(list_intersect(a.s, b.s)) >= len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) GROUP BY 1, 2, 3)
    SELECT conv_id, count(*) AS pairs, round(avg(coalesce(hit, 0) / n), 4) AS reproducibility FROM p LEFT JOIN m USING (conv_id, x, y) GROUP BY conv_id""",
)
def reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    """Over the ordered pairs of a cell's runs, the mean share of a run's claims of which the other has one alike (Jaccard 0.5)."""
    from ..operators.evaluation import reproducibility as measured

    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("run"), F.explode(F.split("text", "\n")).alias("line"))
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("line"), "[^a-z]+"), lambda w: w != "")))
    return measured(turns.select("conv_id", "run", tokens.alias("tokens")), ["conv_id"], "run", "tokens")


_PATTERNS = ["license", "apache", "mit license", "creative commons", "no such words"]


@query(
    "question_matches",
    " UNION ALL ".join(f"SELECT '{p}' AS question, count(*) AS n, count(*) > 3 AS broad FROM documents WHERE text ILIKE '%{p}%'" for p in _PATTERNS),
)
def question_matches(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each question's words match, for all questions in one scan."""
    counts = table(spark, sf, "documents").agg(*[F.count_if(F.col("text").ilike(f"%{p}%")).alias(f"n{i}") for i, p in enumerate(_PATTERNS)])
    rows = F.array(*[F.struct(F.lit(p).alias("question"), F.col(f"n{i}").alias("n"), (F.col(f"n{i}") > 3).alias("broad")) for i, p in enumerate(_PATTERNS)])
    return counts.select(F.inline(rows))


@query(
    "nested_twice",
    """
    WITH s AS (SELECT n_regionkey, n_name, list(s_name ORDER BY s_name) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_name, list(struct_pack(nation := n_name, suppliers := suppliers) ORDER BY n_name) AS nations, count(*) AS n FROM s JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def nested_twice(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    inner = joined.groupBy("n_regionkey", F.col("n_name").alias("nation")).agg(F.sort_array(F.collect_list("s_name")).alias("suppliers"))
    regions = inner.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return regions.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("nation", "suppliers"))).alias("nations"), F.count("*").alias("n"))


_FIRST_WORD = "string_split(text, ' ')[1]"


@query(
    "representative_value",
    f"""
    WITH c AS (SELECT source, {_FIRST_WORD} AS w, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
    SELECT source, w, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, CASE WHEN regexp_matches(w, '^[ -~]+$') THEN 0 ELSE 1 END, w) AS rn FROM c) WHERE rn = 1""",
)
def representative_value(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent value; of ties a plain ASCII one, then the first by name."""
    words = table(spark, sf, "documents").where("text is not null").select("source", F.get(F.split("text", " "), 0).alias("w"))
    counts = words.groupBy("source", "w").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("w", "n"), F.struct(-F.col("n"), F.when(F.col("w").rlike("^[ -~]+$"), 0).otherwise(1), "w")).alias("b")
    return counts.groupBy("source").agg(best).select("source", "b.w", "b.n")


@query("corpus_stats", f"WITH d AS ({_LAST_ORDER}) SELECT count(*) AS n, count(last) AS dated, min(last) AS first_day, max(last) AS last_day FROM d")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return table(spark, sf, "customer").join(last, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("last").alias("dated"), F.min("last").alias("first_day"), F.max("last").alias("last_day"))


_REL_SQL = "CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.2 END"


@query(
    "gather_by_reliability",
    f"""
    WITH d AS (SELECT doc_id, source, n_chars, CAST({_REL_SQL} AS DOUBLE) AS rel FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars >= 40),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(rel, 0.3) DESC, n_chars DESC NULLS LAST, doc_id) AS rn FROM d)
    SELECT doc_id, source, rel FROM r WHERE rn <= 40 ORDER BY coalesce(rel, 0.3) DESC, n_chars DESC NULLS LAST, doc_id LIMIT 600""",
)
def gather_by_reliability(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).alias("rel"))
    docs = table(spark, sf, "documents").where("n_chars >= 40").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    order = [F.coalesce("rel", F.lit(0.3)).desc(), F.desc_nulls_last("n_chars"), F.col("doc_id")]
    return keyed.top_per_group(docs, ["source"], order, 40).orderBy(*order).limit(600).select("doc_id", "source", "rel")


_PREFIX = r"substring(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')), 1, 60)"


@query(
    "stratified_sample",
    f"""
    WITH d AS (SELECT doc_id, lang, source, min(doc_id) OVER (PARTITION BY {_PREFIX}) AS first FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
    a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS i FROM d WHERE doc_id = first),
    b AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY i, source) AS j FROM a)
    SELECT doc_id, lang, source FROM b ORDER BY j, lang LIMIT 60""",
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """By turns of strata, and in them of their parts, without near copies (equal starts of the normalised text)."""
    docs = table(spark, sf, "documents").where("text is not null and lang is not null and source is not null").select("doc_id", "lang", "source", text.prefix_key(F.col("text")).alias("p"))
    firsts = docs.groupBy("p").agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("d")).select("d.*")
    return sampling.by_turns(firsts, "lang", "source", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 60).select("doc_id", "lang", "source")


@query("eval_sample")
def eval_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for questions: by turns of languages, and in one of sources and days; with a source and longer ones first, without near copies."""
    found = sampling.turns_without_copies(eval_candidates(table(spark, sf, "documents")), "lang", "part", [F.desc("score"), F.desc("size"), F.col("doc_id")], "copies", 60)
    return found.select("lang", "part", "turn", "doc_id")


def eval_candidates(docs: DataFrame) -> DataFrame:
    text_ = F.coalesce("text", F.lit(""))
    score = F.when(F.col("source").isNotNull(), 2).otherwise(0) + F.when(F.length(text_) > 60, 1).otherwise(0)
    part = F.concat_ws("|", F.coalesce("source", F.lit("_")), (F.col("doc_id") % 5).cast("string"))
    return docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), part.alias("part"), score.alias("score"), F.length(text_).alias("size"), text.prefix_key(text_, 40).alias("copies"))


@query(
    "diverse_six",
    """
    WITH c AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC NULLS LAST, doc_id) AS a FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS b FROM c WHERE a = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM p)
    SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (ORDER BY b > 1, n_chars DESC NULLS LAST, doc_id) AS place FROM f) WHERE place <= 6""",
)
def diverse_six(spark: SparkSession, sf: str) -> DataFrame:
    """Of each channel its best row; of these the best of each platform, then the others by rank, six in all."""
    order = [F.desc_nulls_last("n_chars"), F.col("doc_id")]
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    channels = keyed.top_per_group(docs, ["lang", "source"], order, 1, "a")
    ranked = channels.withColumn("b", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    return ranked.orderBy(F.col("b") > 1, *order).limit(6).select("doc_id", "source", "lang")


@query(
    "candidates_by_use",
    """
    SELECT source, count(*) FILTER (WHERE toxic = 1) AS hot, count(DISTINCT lang) AS kinds, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
    ORDER BY count(*) FILTER (WHERE toxic = 1) > 0 DESC, kinds DESC, n DESC, source LIMIT 10""",
)
def candidates_by_use(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    found = rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("hot"), F.count_distinct("lang").alias("kinds"), F.count("*").alias("n"))
    return found.orderBy((F.col("hot") > 0).desc(), F.desc("kinds"), F.desc("n"), "source").limit(10)


@query("md5_pair_sample", "SELECT conv_id, turn FROM conversations ORDER BY md5(concat(conv_id, ':', turn)), conv_id, turn LIMIT 50")
def md5_pair_sample(spark: SparkSession, sf: str) -> DataFrame:
    place = F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    return table(spark, sf, "conversations").select("conv_id", "turn").orderBy(place, "conv_id", "turn").limit(50)


@query("retry_ladder", "SELECT source, CAST(count(*) AS BIGINT) AS docs, [s FOR s IN [count(*), CASE WHEN count(*) > 50 THEN 50 END, CASE WHEN count(*) > 25 THEN 25 END] IF s IS NOT NULL] AS sizes FROM documents GROUP BY source")
def retry_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """selection.ladder() as a column: sizes of a batch to try, each smaller than the one before."""
    n = F.count("*")
    sizes = F.filter(F.array(n, *[F.when(n > r, F.lit(r).cast("bigint")) for r in (50, 25)]), lambda s: s.isNotNull())
    return table(spark, sf, "documents").groupBy("source").agg(n.alias("docs"), sizes.alias("sizes"))


_EVIDENCE = "SELECT doc_id, source, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS published, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars % 100 AS DOUBLE) END AS rel FROM documents"


@query(
    "evidence_sort",
    " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, place, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {key} NULLS LAST, doc_id, lower(source) NULLS LAST) AS place FROM ({_EVIDENCE})) WHERE place <= 20"
        for mode, key in {"oldest_published": "published", "newest_published": "published DESC", "reliability": "rel DESC", "label": "lower(source)"}.items()
    ),
)
def evidence_sort(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("published"), F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 100).cast("double")).alias("rel")
    )
    out = None
    for mode in ("oldest_published", "newest_published", "reliability", "label"):
        order = selection.evidence_order(mode, "published", "rel", "doc_id", "source", "doc_id")
        first = docs.orderBy(*order).limit(20)
        first = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint")).select(F.lit(mode).alias("mode"), "place", "doc_id")
        out = first if out is None else out.unionByName(first)
    return out


@query(
    "set_differences",
    """
    SELECT 'ours_only' AS side, doc_id AS id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'theirs_only', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)""",
)
def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    ours = table(spark, sf, "documents").where("n_chars > 500").select(F.col("doc_id").alias("id"))
    theirs = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    only = lambda side, a, b: a.join(b, "id", "left_anti").select(F.lit(side).alias("side"), "id")
    return only("ours_only", ours, theirs).unionByName(only("theirs_only", theirs, ours))
