"""Relational queries: sources, reliability, selections, joins, aggregates, windows and merges over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import keyed
from ..operators.reliability import source_reliability
from ..session import table
from .registry import query

#: Priorities of orders stand for the classes of hedging, from confirmed to unverified; weights in hundredths.
PRIORITY_WEIGHTS = {"1-URGENT": 100, "2-HIGH": 75, "3-MEDIUM": 50, "4-NOT SPECIFIED": 40, "5-LOW": 15}
_WEIGHT_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY_WEIGHTS.items()) + " END"


def _weight():
    return F.expr(_WEIGHT_SQL)


@query(
    "registry_reliability",
    f"""
    WITH c AS (SELECT o_custkey, count(*) AS citations, ((sum({_WEIGHT_SQL}) * 200 + count(*)) // (count(*) * 2)) / 10000.0 AS reliability,
        count(*) FILTER (WHERE o_orderpriority IS NULL) AS unclassified, min(CAST(o_orderdate AS DATE)) AS first_cited, max(CAST(o_orderdate AS DATE)) AS last_cited
      FROM orders GROUP BY o_custkey)
    SELECT o_custkey, c_name, citations, reliability, unclassified, first_cited, last_cited,
      last_cited < CAST((SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 12 MONTH AS DATE) AS decayed
    FROM c JOIN customer ON o_custkey = c_custkey""",
)
def registry_reliability(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))
    scored = source_reliability(orders, ["o_custkey"], "o_orderpriority", "o_orderdate", _weight())
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return scored.join(names, "o_custkey")


@query(
    "registry_by_region",
    f"""
    WITH j AS (SELECT r_name, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, o_custkey, count(*) AS citations, ((sum({_WEIGHT_SQL}) * 200 + count(*)) // (count(*) * 2)) / 10000.0 AS reliability,
      count(*) FILTER (WHERE o_orderpriority IS NULL) AS unclassified, min(d) AS first_cited, max(d) AS last_cited,
      max(d) < CAST((SELECT max(d) FROM j) - INTERVAL 12 MONTH AS DATE) AS decayed
    FROM j GROUP BY r_name, o_custkey""",
)
def registry_by_region(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return source_reliability(joined, ["r_name", "o_custkey"], "o_orderpriority", "o_orderdate", _weight())


@query(
    "recent_top_sources",
    """
    SELECT l_suppkey, s_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 90
    GROUP BY l_suppkey, s_name ORDER BY n DESC, l_suppkey LIMIT 20""",
)
def recent_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    recent = orders.join(F.broadcast(orders.agg(F.max("d").alias("last"))), F.col("d") > F.date_sub("last", 90)).select("o_orderkey")
    counts = table(spark, sf, "lineitem").join(recent, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return counts.join(names, "l_suppkey").select("l_suppkey", "s_name", "n").orderBy(F.desc("n"), "l_suppkey").limit(20)


@query(
    "gather_capped",
    """
    SELECT doc_id, source, n_chars, rn FROM (SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS INTEGER) AS rn
      FROM documents WHERE n_chars >= 40) WHERE rn <= 150 ORDER BY n_chars DESC, doc_id LIMIT 600""",
)
def gather_capped(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").where("n_chars >= 40")
    capped = keyed.top_per_group(docs, ["source"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 150)
    return capped.orderBy(F.desc("n_chars"), "doc_id").limit(600)


@query("latest_per_key", "SELECT DISTINCT ON (user_id) user_id, event_id, ts, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query(
    "top2_dates",
    """
    SELECT event_type, day, n, rn FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n,
      CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(ts AS DATE) DESC) AS INTEGER) AS rn FROM events GROUP BY 1, 2) WHERE rn <= 2""",
)
def top2_dates(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return keyed.top_per_group(days, ["event_type"], [F.desc("n"), F.desc("day")], 2)


@query(
    "cohort_max_over",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag = 'R') AS cohort_last
    FROM lineitem WHERE l_returnflag = 'R'""",
)
def cohort_max_over(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    # max() over the whole input is an aggregate of one row; a window would put all rows in one task
    return rows.join(F.broadcast(rows.agg(F.max("shipped").alias("cohort_last"))))


@query(
    "pressure_by_entity",
    """
    SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT event_id) FILTER (WHERE event_type = 'error') AS pressure,
      list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id""",
)
def pressure_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_distinct(F.to_date("ts")).alias("days"),
        F.count_distinct(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("pressure"),
        F.sort_array(F.collect_set("event_type")).alias("kinds"),
    )


@query(
    "corroborated_share",
    """
    SELECT source, count(*) AS texts, round(count(*) FILTER (WHERE docs >= 2) / count(*), 4) AS share
    FROM (SELECT source, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, count(*) AS docs FROM documents GROUP BY 1, 2) GROUP BY source""",
)
def corroborated_share(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import content_md5

    each = table(spark, sf, "documents").groupBy("source", content_md5(F.col("text")).alias("k")).agg(F.count("*").alias("docs"))
    return each.groupBy("source").agg(F.count("*").alias("texts"), F.round(F.count_if(F.col("docs") >= 2) / F.count("*"), 4).alias("share"))


@query(
    "source_parity",
    """
    WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) > (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 365 GROUP BY 1),
    i AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT n_name, count(*) AS sources, count(i.l_suppkey) AS ingested, round(100.0 * sum(CASE WHEN i.l_suppkey IS NULL THEN 0 ELSE n END) / sum(n), 2) AS weighted_pct
    FROM r LEFT JOIN i ON r.l_suppkey = i.l_suppkey JOIN supplier ON r.l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def source_parity(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("d"))
    last = F.broadcast(items.agg(F.max("d").alias("last")))
    recent = items.join(last, F.col("d") > F.date_sub("last", 365)).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    ingested = items.where("l_returnflag = 'R'").select("l_suppkey").distinct().withColumn("there", F.lit(True))
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    joined = recent.join(ingested, "l_suppkey", "left").join(places, "l_suppkey")
    covered = F.sum(F.when(F.col("there"), F.col("n")).otherwise(0))
    return joined.groupBy("n_name").agg(F.count("*").alias("sources"), F.count("there").alias("ingested"), F.round(covered * 100.0 / F.sum("n"), 2).cast("double").alias("weighted_pct"))


@query("semi_exists", "SELECT doc_id, source, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1")
    return table(spark, sf, "documents").select("doc_id", "source", "lang").join(good, "doc_id", "left_semi")


@query("anti_missing", "SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1")
    return table(spark, sf, "documents").select("doc_id", "source", "lang").join(good, "doc_id", "left_anti")


@query(
    "all_and_none",
    """
    SELECT o_custkey, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F')
      AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P') GROUP BY o_custkey""",
)
def all_and_none(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("some"), F.bool_or(F.col("o_orderstatus") == "P").alias("bad"))
    return counts.where("some and not coalesce(bad, false)").select("o_custkey", "n")


@query(
    "corr_scalar",
    """
    SELECT n_name, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS last_order,
      (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n_orders FROM nation""",
)
def corr_scalar(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    each = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max(F.to_date("o_orderdate")).alias("last_order"), F.count("*").alias("n_orders"))
    nations = table(spark, sf, "nation").join(each, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return nations.select("n_name", "last_order", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("corr_top1", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM customer")
def corr_top1(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query(
    "scalar_vector",
    "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_order",
)
def scalar_vector(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
    parts = [table(spark, sf, "labels").agg(F.count("*").alias("labels")), table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate")).alias("last_order"))]
    for p in parts:
        docs = docs.join(F.broadcast(p))  # one row each
    return docs


@query(
    "neighbors",
    """
    SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query(
    "graph_edges_both_dirs",
    """
    WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
    SELECT c AS node, s AS other, 'out' AS direction FROM e UNION ALL SELECT s, c, 'in' FROM e""",
)
def graph_edges_both_dirs(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    edges = items.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    # each edge twice by an array, not by computing the join twice
    both = F.array(F.struct(F.col("o_custkey").alias("node"), F.col("l_suppkey").alias("other"), F.lit("out").alias("direction")), F.struct(F.col("l_suppkey").alias("node"), F.col("o_custkey").alias("other"), F.lit("in").alias("direction")))
    return edges.select(F.inline(both))


@query(
    "evidence_star",
    """
    SELECT o_orderkey, c_name, n_name, r_name, l_linenumber, s_name, p_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT'""",
)
def evidence_star(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    orders = t("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey"))
    items = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = joined.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    joined = joined.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("o_orderkey", "c_name", "n_name", "r_name", "l_linenumber", "s_name", "p_name")


@query("json_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").where(k.isNotNull()).groupBy(k.try_cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "tristate_jobs",
    """
    SELECT event_type, count(*) FILTER (WHERE value > 60) AS ok, count(*) FILTER (WHERE value <= 60) AS failed, count(*) FILTER (WHERE value IS NULL) AS open,
      count(*) FILTER (WHERE (value > 60) IS DISTINCT FROM true) AS not_ok FROM events GROUP BY event_type""",
)
def tristate_jobs(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("value") > 60
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(ok.isNull()).alias("open"), F.count_if(~ok.eqNullSafe(F.lit(True))).alias("not_ok"))


@query("group_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def group_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "counts_two_dims",
    "SELECT source, CAST(NULL AS VARCHAR) AS lang, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT NULL, lang, count(*) FROM documents GROUP BY lang",
)
def counts_two_dims(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupingSets([[docs.source], [docs.lang]], docs.source, docs.lang).agg(F.count("*").alias("n"))


@query("corpus_version", "SELECT concat(max(doc_id), ':', count(*)) AS version FROM documents")
def corpus_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.concat_ws(":", F.max("doc_id"), F.count("*")).alias("version"))


@query(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")),
)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages"):
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("md5_sample", "SELECT doc_id, source FROM documents ORDER BY md5(concat('seed:', doc_id)), doc_id LIMIT 100")
def md5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").orderBy(F.md5(F.concat(F.lit("seed:"), F.col("doc_id"))), "doc_id").limit(100)


@query("page_of_rows", "SELECT doc_id, source, n_chars FROM documents ORDER BY source = 'src0' DESC, n_chars DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50")
def page_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return docs.orderBy((F.col("source") == "src0").desc(), F.desc_nulls_last("n_chars"), "doc_id").offset(50).limit(50)


@query("keyset_resume", "SELECT vec_id, label FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 128")
def keyset_resume(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label").where("vec_id > 100").orderBy("vec_id").limit(128)


@query(
    "systematic_sample",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 100 = 0 ORDER BY o_orderkey LIMIT 100",
)
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.sampling import every_nth

    return every_nth(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100).orderBy("o_orderkey").limit(100)


@query(
    "stalest_first",
    "SELECT c_custkey, last_order FROM (SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY last_order NULLS FIRST, c_custkey LIMIT 40",
)
def stalest_first(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left").orderBy(F.asc_nulls_first("last_order"), "c_custkey").limit(40)


@query(
    "scoreboard_summary",
    """
    SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(avg(value) FILTER (WHERE value <> 0), 4) AS nonzero_mean,
      count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE value <> 0) AS nonzero_days, round(stddev_samp(value), 4) AS sd FROM events GROUP BY event_type""",
)
def scoreboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    nonzero = F.when(value != 0, value)
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.median(value), 4).alias("median"),
        F.round(F.avg(nonzero), 4).alias("nonzero_mean"),
        F.count_distinct(F.when(value != 0, F.to_date("ts"))).alias("nonzero_days"),
        F.round(F.stddev_samp(value), 4).alias("sd"),
    )


@query(
    "coverage_lead",
    """
    WITH h AS (SELECT o_orderpriority AS theater, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) * 24.0 AS lead, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT theater, count(*) AS claims, list_sort(list(lead))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median_lead,
      round(count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 4) AS thin_rate FROM h GROUP BY theater""",
)
def coverage_lead(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.validation import upper_median

    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("o"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("s")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lead = items.select(F.col("o_orderpriority").alias("theater"), (F.datediff("s", "o") * F.lit(24.0)).alias("lead"), "l_returnflag")
    rates = lead.groupBy("theater").agg(F.count("*").alias("claims"), F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 4).alias("thin_rate"))
    return rates.join(upper_median(lead, ["theater"], "lead", "upper_median_lead"), "theater")


@query(
    "upsert_coalesce",
    """
    WITH o AS (SELECT user_id, max(value) FILTER (WHERE event_type <> 'error') AS v FROM events WHERE CAST(ts AS DATE) < (SELECT min(CAST(ts AS DATE)) FROM events) + 10 GROUP BY 1),
    n AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'error') AS v FROM events WHERE CAST(ts AS DATE) >= (SELECT min(CAST(ts AS DATE)) FROM events) + 10 GROUP BY 1)
    SELECT user_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (user_id)""",
)
def upsert_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "value", "event_type", F.to_date("ts").alias("d"))
    events = events.join(F.broadcast(events.agg(F.min("d").alias("first"))))
    early = F.col("d") < F.date_add("first", 10)
    old = events.where(early).groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("value"))).alias("v"))
    new = events.where(~early).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("v"))
    return keyed.upsert(old, new, ["user_id"], keep_old=True)


@query("upsert_add", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY 1, 2")
def upsert_add(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value", "event_id")
    count = lambda df: df.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    return keyed.additive_upsert(count(events.where("event_id % 2 = 0")), count(events.where("event_id % 2 <> 0")), ["event_type", "day"], ["n", "high"])


@query(
    "insert_ignore",
    """
    WITH t AS (SELECT DISTINCT ON (user_id) user_id, event_id FROM events WHERE event_type = 'error' ORDER BY user_id, event_id),
    b AS (SELECT DISTINCT ON (user_id) user_id, event_id FROM events WHERE event_type <> 'error' ORDER BY user_id, event_id)
    SELECT * FROM t UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM t)""",
)
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    first = events.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return keyed.insert_ignore(first, events.where("event_type <> 'error'").select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query(
    "next_ordinal",
    """
    WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1),
    b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role <> 'user')
    SELECT conv_id, turn, CAST(coalesce(last, 0) + n AS BIGINT) AS seq FROM b LEFT JOIN l USING (conv_id) WHERE coalesce(last, 0) + n <= 8""",
)
def next_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    existing = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("seq"))
    return keyed.next_ordinals(existing, turns.where("role <> 'user'").select("conv_id", "turn", "text"), "conv_id", "seq", [F.col("turn"), F.col("text")], 8).select("conv_id", "turn", "seq")


@query(
    "retention_redact",
    "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 14 DAY THEN '[deleted]' ELSE props END AS props FROM events",
)
def retention_redact(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return keyed.redact(table(spark, sf, "events").select("event_id", "ts", "props"), "ts", ["props"], as_of, 14).drop("ts")


@query("event_log_replay", "SELECT conv_id, turn, role FROM conversations WHERE turn > 1 ORDER BY conv_id, turn")
def event_log_replay(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("turn > 1").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("set_difference", "SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("n_chars > 500").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "roster_union",
    "SELECT lower(s_name) AS name, 'curated' AS origin FROM supplier WHERE s_suppkey <= 20 UNION ALL SELECT DISTINCT lower(s_name), 'registry' FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey <= 20)",
)
def roster_union(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select("s_suppkey", F.lower("s_name").alias("name"))
    curated = names.where("s_suppkey <= 20").select("name")
    rest = names.select("name").distinct().join(curated, "name", "left_anti")
    return curated.withColumn("origin", F.lit("curated")).unionByName(rest.withColumn("origin", F.lit("registry")))


@query("null_safe_distinct", "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def null_safe_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(~F.col("lang").eqNullSafe("en")).select("doc_id", "lang")


@query(
    "majority_vote",
    """
    WITH v AS (SELECT o_custkey, o_orderstatus, count(*) AS votes, sum(count(*)) OVER (PARTITION BY o_custkey) AS k FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderstatus, votes FROM v WHERE votes >= floor(k / 2) + 1""",
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.validation import majority

    return majority(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query(
    "half_open_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) < DATE '1995-01-01' + 30",
)
def half_open_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").where((day >= F.lit("1995-01-01").cast("date")) & (day < F.lit("1995-01-31").cast("date"))).select("o_orderkey", day.alias("d"))


@query(
    "row_value_in",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('P', '5-LOW'))",
)
def row_value_in(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.struct("o_orderstatus", "o_orderpriority").isin([F.struct(F.lit(a), F.lit(b)) for a, b in (("F", "1-URGENT"), ("P", "5-LOW"))])
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").where(wanted)


@query(
    "nested_groups",
    """
    SELECT conv_id, list(struct_pack(turn := turn, role := role) ORDER BY turn, role) AS turns, count(*) AS n FROM conversations GROUP BY conv_id""",
)
def nested_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"), F.count("*").alias("n"))


@query(
    "mode_with_ties",
    "SELECT source, lang AS mode, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
)
def mode_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return keyed.top_per_group(counts, ["source"], [F.desc("n"), F.col("lang")], 1).select("source", F.col("lang").alias("mode"), "n")
