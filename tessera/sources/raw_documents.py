"""Sources of raw documents. Each gives the same columns, so that ingestion is one path whatever the source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, detect_language
from ..operators.keyed import insert_ignore
from ..session import ship

#: Characters of a document's content that are kept.
MOST = 8000
RAW_DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("adapter", "external_id", "url", "title", "content", "lang", "country")]
    + [T.StructField("published_at", T.TimestampType()), T.StructField("source_key", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
)
#: Languages whose documents go to a theater of their own, whatever the source's.
THEATERS = {"uk": "ua", "fa": "ir"}


def theater(lang, default):
    """The theater of a language where it is unambiguous, else the source's."""
    return F.coalesce(*[F.when(lang == k, F.lit(v)) for k, v in THEATERS.items()], default)


def _rows(files: DataFrame, adapter: str, source_key: str, parse, meta: dict[str, str]) -> DataFrame:
    """Raw documents of whole files (path, content) by a parser that gives dicts."""
    ship(files.sparkSession)
    fields = ["external_id", "url", "title", "content", "published"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                found = parse(data.as_py().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in found], pa.string()) for f in fields], fields)

    parsed = files.select("content").mapInArrow(run, ", ".join(f"{f} string" for f in fields))
    return parsed.select(
        F.lit(adapter).alias("adapter"),
        "external_id",
        "url",
        F.trim("title").alias("title"),
        F.substring(F.trim("content"), 1, MOST).alias("content"),
        detect_language(F.col("content")).alias("lang"),
        F.lit(None).cast("string").alias("country"),
        F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp(F.regexp_replace("published", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))).alias("published_at"),
        F.lit(source_key).alias("source_key"),
        F.create_map(*[F.lit(x) for kv in (meta or {"from": adapter}).items() for x in kv]).alias("meta"),
    )


def parse_feed(xml: str) -> list[dict]:
    """Items of an RSS or Atom feed; nothing for what isn't XML."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for item in (e for e in root.iter() if local(e) in ("item", "entry")):
        parts = {local(c): c for c in item}
        text = lambda *names: next(("".join(parts[n].itertext()).strip() for n in names if n in parts), None)
        link = text("link") or (parts["link"].get("href") if "link" in parts else None)
        body = text("encoded", "content", "description", "summary") or text("title") or ""
        out.append({"external_id": text("guid", "id") or link, "url": link, "title": text("title"), "content": unescape(re.sub(r"<[^>]+>", " ", body)), "published": text("pubDate", "published", "updated", "date")})
    return out


def feeds(spark: SparkSession, path: str, source_key: str) -> DataFrame:
    """RSS and Atom files."""
    return _rows(spark.read.format("binaryFile").load(path), "rss", source_key, parse_feed, {})


_MESSAGE = re.compile(r'<div[^>]*class="[^"]*tgme_widget_message[ "][^>]*data-post="([^"]+)"(.*?)(?=<div[^>]*class="[^"]*tgme_widget_message[ "]|\Z)', re.S)
_TEXT = re.compile(r'class="[^"]*tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', re.S)
_TIME = re.compile(r'<time[^>]*datetime="([^"]+)"')


def parse_channel(html: str) -> list[dict]:
    """Messages with a text of a channel's public page."""
    out = []
    for post, body in _MESSAGE.findall(html):
        text, time = _TEXT.search(body), _TIME.search(body)
        content = unescape(re.sub(r"<[^>]+>", "", text[1])).strip() if text else ""
        if content:
            out.append({"external_id": post, "url": f"https://t.me/{post}", "title": None, "content": content, "published": time[1] if time else None})
    return out


def channel_pages(spark: SparkSession, path: str, channel: str, default_theater: str) -> DataFrame:
    rows = _rows(spark.read.format("binaryFile").load(path), "telegram_web", f"t.me/{channel.lower()}", parse_channel, {})
    return rows.withColumn("country", theater(F.col("lang"), F.lit(default_theater)))


def article_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON article lists of a news monitor: {"articles": [{url, title, seendate, domain, language}]}."""
    article = "articles array<struct<url: string, title: string, seendate: string, domain: string, language: string>>"
    rows = spark.read.schema(article).option("multiLine", True).json(path).select(F.inline("articles"))
    return rows.select(
        F.lit("gdelt").alias("adapter"),
        F.col("url").alias("external_id"),
        "url",
        "title",
        F.substring("title", 1, MOST).alias("content"),
        F.lower("language").alias("lang"),
        F.lit(None).cast("string").alias("country"),
        F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmssX")).alias("published_at"),
        F.col("domain").alias("source_key"),
        F.create_map(F.lit("domain"), F.col("domain")).alias("meta"),
    ).where("url is not null")


def fixtures(spark: SparkSession, path: str, adapter: str = "stub") -> DataFrame:
    """JSON lines of documents; their content is marked, so that they can't be taken for real ones."""
    rows = spark.read.schema("id string, title string, content string, lang string, country string, source_key string, published_at timestamp").json(path)
    return rows.select(
        F.lit(adapter).alias("adapter"),
        F.col("id").alias("external_id"),
        F.lit(None).cast("string").alias("url"),
        "title",
        F.concat(F.lit("[stub] "), F.coalesce("content", F.lit(""))).alias("content"),
        "lang",
        "country",
        "published_at",
        "source_key",
        F.create_map(F.lit("stub"), F.lit("true")).alias("meta"),
    )


def trade_flows(spark: SparkSession, path: str) -> DataFrame:
    """JSON of a trade statistics service: rows of {"data": [...]} with a partner and a numeric value, without the world aggregate."""
    row = "data array<struct<reporterCode: int, reporterDesc: string, partnerCode: int, partnerDesc: string, flowCode: string, cmdCode: string, period: string, primaryValue: string>>"
    flat = spark.read.schema(row).option("multiLine", True).json(path).select(F.inline("data"))
    value = F.col("primaryValue").try_cast("double")
    return flat.where(F.col("partnerCode").isNotNull() & (F.col("partnerCode") != 0) & value.isNotNull()).select(
        F.col("reporterCode").alias("reporter"), F.col("reporterDesc").alias("reporter_name"), F.col("partnerCode").alias("partner"), F.col("partnerDesc").alias("partner_name"), F.col("flowCode").alias("flow"), F.col("cmdCode").alias("hs"), "period", value.alias("usd")
    )


def ingest(table: DataFrame, batch: DataFrame) -> DataFrame:
    """table and the batch's new documents, by content hash: what was read before, or twice, is taken once."""
    key = content_hash(F.col("adapter"), F.col("external_id"), F.col("title"), F.col("content"))
    hashed = batch.withColumn("content_hash", key)
    return insert_ignore(table, hashed, ["content_hash"], [F.col("published_at").asc_nulls_last(), F.col("external_id")])


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Records as lines of JSON, added to what is there."""
    df.write.mode(mode).json(path)


def since_marks(messages: DataFrame, marks: DataFrame, channel: str = "channel", number: str = "message_id") -> DataFrame:
    """Messages above their channel's mark (channel, high_mark); channels without a mark give all."""
    m = marks.select(F.col(channel).alias("__c"), F.col("high_mark").alias("__m"))
    known = messages.join(m, F.lower(F.col(channel)) == F.lower("__c"), "left")
    return known.where(F.col("__m").isNull() | (F.col(number) > F.col("__m"))).drop("__c", "__m")


def search_batches(names: list[str], since: int, size: int = 20) -> list[str]:
    """Search questions for the posts of some accounts each since a time."""
    return [f"({' OR '.join(f'from:{n}' for n in names[k : k + size])}) since_time:{since}" for k in range(0, len(names), size)]


#: The two shapes in which the search gives posts.
_POSTS = "tweets array<struct<id: string, text: string, createdAt: string, author: struct<userName: string>>>, data struct<tweets: array<struct<id: string, text: string, createdAt: string, author: struct<userName: string>>>>, next_cursor string, has_next_page boolean"


def posts(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """id, text, created_at, author of pages of a post search, in either shape; repeated posts once."""
    page = F.from_json(raw, _POSTS)
    found = pages.select(F.explode(F.coalesce(page.getField("tweets"), page.getField("data").getField("tweets"))).alias("p"))
    return found.select("p.id", "p.text", F.col("p.createdAt").alias("created_at"), F.lower("p.author.userName").alias("author")).where("id is not null and text <> ''").dropDuplicates(["id"])


#: How result rows of procurement pages are marked.
_ROW = r'(?=<div[^>]*class="[^"]*(?:search-registry-entry-block|registry-entry__block))'
_NUMBER = r'(?is)<a[^>]*href="([^"]*regNumber[^"]*)"[^>]*>(.*?)</a>'
_SUBJECT = r'(?is)class="[^"]*registry-entry__body-value[^"]*"[^>]*>(.*?)</'


def tenders(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """number, url, title of the result rows of procurement pages; rows without a number and a subject are left out."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    rows = pages.select(F.explode(F.split(html, _ROW)).alias("r")).where(F.col("r").rlike(r'^<div[^>]*class="[^"]*(?:search-registry-entry-block|registry-entry__block)'))
    number, href, subject = plain(F.regexp_extract("r", _NUMBER, 2)), F.regexp_extract("r", _NUMBER, 1), plain(F.regexp_extract("r", _SUBJECT, 1))
    found = rows.select(number.alias("number"), F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)).alias("url"), subject.alias("subject")).where("number <> '' or subject <> ''")
    return found.select("number", "url", F.when(F.col("subject") != "", F.substring("subject", 1, 300)).otherwise(F.concat(F.lit("Tender "), "number")).alias("title"))


def cached_name(url: Column) -> Column:
    """The name of the file that keeps a fetched page."""
    return F.concat(F.sha1(url), F.lit(".html"))


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """name, html of a folder of fetched pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("html"))
