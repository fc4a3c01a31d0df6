"""Queries on names, pages, URLs, streams and sources over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, urls
from ..operators import entities, freshness, html_reports, signals
from ..session import shared_dir, table
from ..streaming import incremental, tail
from .registry import picked, query


_CITED = ["https://t.me/s/Chan", "https://twitter.com/@User", "https://www.mod.gov.ua/n/", f"http://{urls.STATE_MEDIA[0]}/a?b=", f"https://WWW.{urls.INDEPENDENT_MEDIA[0]}/", f"https://{urls.OWN_HOSTS[0]}/", "https://t.me/", "no address "]


@query(
    "url_sources",
    f"""
    WITH p AS (SELECT page_id, page_id % 9 AS k, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages WHERE url IS NOT NULL)
    SELECT page_id, CASE k WHEN 0 THEN concat('t.me/chan', page_id) WHEN 1 THEN concat('x.com/user', page_id) WHEN 2 THEN 'mod.gov.ua' WHEN 3 THEN '{urls.STATE_MEDIA[0]}' WHEN 4 THEN '{urls.INDEPENDENT_MEDIA[0]}' WHEN 6 THEN concat('t.me/', page_id) WHEN 8 THEN host END AS key,
      CASE k WHEN 0 THEN 't.me' WHEN 1 THEN 'x.com' WHEN 2 THEN 'mod.gov.ua' WHEN 3 THEN '{urls.STATE_MEDIA[0]}' WHEN 4 THEN '{urls.INDEPENDENT_MEDIA[0]}' WHEN 6 THEN 't.me' WHEN 8 THEN host END AS domain,
      CASE k WHEN 0 THEN 'telegram' WHEN 1 THEN 'x' WHEN 2 THEN 'gov' WHEN 3 THEN 'state_media' WHEN 4 THEN 'independent_media' WHEN 6 THEN 'telegram' WHEN 8 THEN 'other' END AS platform FROM p""",
)
def url_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Who pages cite: channels, accounts, outlets of each kind, their own hosts, and addresses of none."""
    k = F.col("page_id") % 9
    cited = F.when(k == 8, F.col("url")).otherwise(F.concat(picked(_CITED, k), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").where("url is not null").select("page_id", urls.source(cited).alias("s")).select("page_id", "s.key", "s.domain", "s.platform")


@query("html_extract")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_reports.parsed(table(spark, sf, "pages"), "page_id", "html")


_HEDGED = ["The ministry claimed it.", "Geolocated footage shows it.", "It rained."]


@query(
    "page_reports",
    """
    SELECT page_id, printf('Update, May %d, 2024', 1 + page_id % 28) AS title, printf('2024-05-%02d', 1 + page_id % 28) AS report_date, [concat('Item ', page_id, '.'), concat('Host ', regexp_extract(url, '^https?://([^/?#:]+)', 1), '.')] AS takeaways,
      list_transform(range(1, 1 + page_id % 4), lambda j: struct_pack(endnote := j, url := concat('https://a.example/', page_id * 10 + j), hedging := ['claimed', 'confirmed', 'unknown'][1 + (page_id + j) % 3])) AS citations, page_id % 4 > 0 AS ok
    FROM pages WHERE url IS NOT NULL""",
)
def page_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made reports of: a dated heading, takeaways, paragraphs with markers, and their endnotes, which are blocks within a block."""
    i, numbers = F.col("page_id"), F.sequence(F.lit(1), F.lit(3))
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    day = (1 + i % 28).cast("string")
    said = F.transform(numbers, lambda j: F.concat(picked(_HEDGED, i + j), F.lit("["), j, F.lit("] ")))
    notes = F.transform(F.filter(numbers, lambda j: j <= i % 4), lambda j: F.concat(F.lit("<div>["), j, F.lit("] <a>https://a.example/"), i * 10 + j, F.lit("</a></div>")))
    dressed = F.concat(
        F.lit("<h1>Update, May "), day, F.lit(", 2024</h1><h2>Key Takeaways</h2><ul><li>Item "), i, F.lit(".</li><li>Host "), host, F.lit(".</li></ul><p>"), F.array_join(said, ""), F.lit("</p>"),
        F.coalesce("html", F.lit("")), F.lit('<div class="endnote-accordion-content"><div>'), F.array_join(notes, ""), F.lit("</div></div>"),
    )
    found = html_reports.reports(table(spark, sf, "pages").where("url is not null").select("page_id", dressed.alias("html")), "page_id", "html")
    cited = F.transform("citations", lambda c: F.struct(c.getField("endnote").alias("endnote"), c.getField("url").alias("url"), c.getField("hedging").alias("hedging")))
    return found.select("page_id", "title", "report_date", "takeaways", cited.alias("citations"), "ok")


@query(
    "latest_periods",
    """
    WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS a, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) + CAST(o_orderkey % 400 AS INTEGER) - 200 AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '2031' WHEN o_orderkey % 5 = 1 THEN 'май 2030' ELSE strftime(greatest(a, b), '%d.%m.%Y') END AS label FROM o""",
)
def latest_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages that name two days, and some a later month or year."""
    k, first = F.col("o_orderkey"), F.to_date(F.col("o_orderdate") + F.make_ym_interval(F.lit(20)))
    shown = lambda d: F.date_format(d, "dd.MM.yyyy")
    later = F.when(k % 5 == 0, " 2031 2022").when(k % 5 == 1, ", май 2030 и январь 2023").otherwise(" и 31.02.2099")
    page = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit("данные за "), shown(first), F.lit(" и "), shown(F.date_add(first, (k % 400).cast("int") - 200)), later))
    return table(spark, sf, "orders").select("o_orderkey", freshness.latest_period(page, r"\d{2}\.\d{2}\.20\d\d|[а-яё]+\s+20\d\d|20\d\d").alias("label"))


def _actors(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers as named actors, some with titles or other spellings."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Dr "), F.col("c_name"))).otherwise(F.upper("c_name")).alias("name"))
    again = people.where("id % 5 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lower("name").alias("name"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("claims"))
    return people.unionByName(again).join(orders, "id", "left").select("id", "name", F.lit("person").alias("kind"), F.coalesce("claims", F.lit(0)).alias("claims"))


@query("entity_merge_plan")
def entity_merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    return entities.merge_plan(_actors(spark, sf))[1]


@query(
    "entity_keys",
    "SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name)), '[-–]', ' ', 'g'), '[^\\p{L}\\p{N} ]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM customer",
)
def entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", names.key(F.col("c_name")).alias("key"))


_ROLE = "CASE o_orderkey % 4 WHEN 0 THEN 'defendant' WHEN 1 THEN 'target' WHEN 2 THEN 'patron' ELSE 'other' END"
_SAYS = "CASE o_orderkey % 3 WHEN 0 THEN 'was arrested on Monday' WHEN 1 THEN 'gave a speech' ELSE 'Sanctions were lifted' END"


@query(
    "purge_signals",
    f"""
    WITH o AS (SELECT o_orderpriority AS theater, o_orderkey, lower(c_name) AS person, o_orderkey % 5 <> 0 AS human, {_ROLE} AS role, {_SAYS} AS says, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT theater, count(DISTINCT person) AS persons, count(DISTINCT o_orderkey) AS claims FROM o
      WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 30 AND human AND (role = 'defendant' OR (role IN ('target', 'other') AND regexp_matches(says, '(?i)\\b(arrest\\w*|sanction\\w*)\\b'))) GROUP BY 1)
    SELECT *, CASE WHEN persons >= 20 THEN 'elevated' ELSE 'watch' END AS severity FROM p WHERE persons >= 10""",
)
def purge_signals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = orders.join(who, "o_custkey").withColumns(
        {
            "person": F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("Dr. "), "c_name")),  # two spellings of one name
            "kind": F.when(k % 5 != 0, "person").otherwise("agency"),
            "role": F.when(k % 4 == 0, "defendant").when(k % 4 == 1, "target").when(k % 4 == 2, "patron").otherwise("other"),
            "says": F.when(k % 3 == 0, "was arrested on Monday").when(k % 3 == 1, "gave a speech").otherwise("Sanctions were lifted"),
        }
    )
    last = orders.agg(F.max("d")).head()[0]
    return signals.purges(rows.withColumnRenamed("o_orderpriority", "theater"), "theater", "person", "kind", "role", "says", "o_orderkey", "d", F.lit(last), 30, 10)


@query(
    "dark_signals",
    """
    WITH s AS (SELECT user_id % 7 AS t, CASE event_type WHEN 'error' THEN 'gone' WHEN 'click' THEN 'ok' WHEN 'view' THEN 'stale' ELSE 'classified' END AS status, value > 99 AS recent FROM events),
    d AS (SELECT t, count(*) AS dark, bool_or(recent) AS recent FROM s WHERE status <> 'ok' GROUP BY t)
    SELECT t AS theater, dark, recent, CASE WHEN recent THEN 'elevated' ELSE 'watch' END AS severity FROM d ORDER BY severity, theater""",
)
def dark_signals(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "gone").when(kind == "click", "ok").when(kind == "view", "stale").otherwise("classified")
    series = table(spark, sf, "events").select((F.col("user_id") % 7).alias("theater"), status.alias("status"), (F.col("value") > 99).alias("changed_recently"))
    found = signals.dark_series(series)
    return signals.ranked(found.withColumns({"kind": F.lit("dark"), "key": F.col("theater")})).drop("kind", "key")


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return incremental.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    once = incremental.first_arrivals(_events(spark, sf).select("event_id", "event_type", "ts"), ["event_id"], "ts")
    to = _checkpoint(spark)
    incremental.write_available(once, f"{to}/rows", f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_high_marks", "SELECT user_id, max(event_id) AS high_mark, count(*) AS n FROM events GROUP BY user_id")
def stream_high_marks(spark: SparkSession, sf: str) -> DataFrame:
    to = _checkpoint(spark)
    return incremental.marks_available(_events(spark, sf), "user_id", "event_id", f"{to}/rows", f"{to}/checkpoint")


_RUN_EVENTS = ["run.created", "retrieval.lexical_partial", "retrieval.completed", "answer.started", "run.completed", "run.failed", "other"]


@query(
    "live_run_views",
    f"""
    WITH e AS (SELECT user_id AS run, event_id AS seq, [{", ".join(f"'{e}'" for e in _RUN_EVENTS)}][CAST(1 + (event_id * 17 + user_id) % CASE WHEN user_id % 3 = 0 THEN 7 ELSE 4 END AS BIGINT)] AS event FROM events),
    r AS (SELECT run, max(seq) AS last_seq, max(CASE event WHEN 'run.created' THEN 0 WHEN 'retrieval.lexical_partial' THEN 1 WHEN 'retrieval.completed' THEN 2 WHEN 'answer.started' THEN 3 WHEN 'run.completed' THEN 4 WHEN 'run.failed' THEN 4 END) AS p,
      arg_min(event, seq) FILTER (WHERE event IN ('run.completed', 'run.failed')) AS e FROM e GROUP BY run)
    SELECT run, last_seq, CASE WHEN e = 'run.failed' THEN 'failed' ELSE ['starting', 'retrieving', 'selecting', 'answering', 'done'][1 + coalesce(p, 0)] END AS phase FROM r""",
)
def live_run_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views of runs that a stream of events keeps up to date."""
    u, e = F.col("user_id"), F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in _RUN_EVENTS]), ((e * 17 + u) % F.when(u % 3 == 0, 7).otherwise(4)).cast("int"))
    to = _checkpoint(spark)
    views = tail.live_views(_events(spark, sf).select(u.alias("run"), e.alias("seq"), kind.alias("event")), "run")
    return tail.views_available(views, "run", f"{to}/rows", f"{to}/checkpoint")
