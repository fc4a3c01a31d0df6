"""Queries on kept indexes: nearest vectors, words in texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_search, vector_index
from ..session import shared_dir, table
from .registry import query


def _store(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


@query("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """About the ten nearest of all vectors to each fiftieth, by an index over all; recall is tested against whole scans."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    vector_index.build(vectors, store := _store(spark, "vector-index"), "vec_id", "embedding", 64)
    found = vector_index.search(vectors.where(F.col("vec_id") % 50 == 0), store, "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_TEXTS = """
d AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 3 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS day, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM d)),
x AS (SELECT id, p, CASE WHEN w IN ('license', 'licenses', 'licensed', 'licensing') THEN 'licens' WHEN w IN ('work', 'works', 'worked', 'working') THEN 'work' WHEN w IN ('public', 'publication', 'publications', 'publicity') THEN w
  WHEN w IN ('general', 'generally') THEN 'general' WHEN w = 'mit' THEN w END AS x FROM t)"""
_PAGE = "SELECT id AS doc_id, day, round(rank, 6) AS rank, (SELECT count(*) FROM m) AS match_count FROM m ORDER BY round(rank, 7) DESC, day DESC NULLS LAST, id DESC LIMIT 150"


def _texts(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A kept index of documents, and their sources as names."""
    id_ = F.col("doc_id")
    day = F.when(id_ % 7 != 3, F.date_add(F.lit("2024-01-01").cast("date"), (id_ % 60).cast("int")))
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", day.alias("day"))
    text_search.build(docs, store := _store(spark, "text-index"), "doc_id", "text", "day")
    return store, docs.select(id_.alias("id"), F.col("source").alias("name"), "day")


def _page(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "day", F.round("rank", 6).alias("rank"), "match_count")


@query(
    "fulltext_page",
    f"""
    WITH {_TEXTS}, a AS (SELECT id, p FROM x WHERE x = 'licens'), b AS (SELECT id, p FROM x WHERE x = 'work'),
    r AS (SELECT a.id, 1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5 - 2)) END)))) AS rank FROM a JOIN b ON a.id = b.id GROUP BY a.id),
    m AS (SELECT d.id, day, coalesce(rank, 0) AS rank FROM d LEFT JOIN r USING (id) WHERE r.id IS NOT NULL OR text ILIKE '%apache%' OR text ILIKE '%mit-l%' OR source ILIKE '%apache%')
    {_PAGE}""",
)
def fulltext_page(spark: SparkSession, sf: str) -> DataFrame:
    """Both words, ranked by their distances, or one of two terms in texts or sources."""
    store, names = _texts(spark, sf)
    return _page(text_search.search(spark, store, "the licensed works", ["apache", "mit-l"], 150, names))


@query(
    "fulltext_alternatives",
    f"""
    WITH {_TEXTS}, g AS (SELECT a.id FROM x a JOIN x b ON a.id = b.id AND b.p = a.p + 1 WHERE a.x = 'general' AND b.x = 'public' GROUP BY a.id),
    n AS (SELECT id, x, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY id, x), h AS (SELECT id, bool_or(x = 'mit') AS mit, bool_or(x = 'licens') AS licens FROM n GROUP BY id),
    r AS (SELECT id, sum(0.1 * list_sum(list_transform(range(1, n + 1), lambda j: 1 / (j * j)))) / 1.64493406685 / 4 AS rank FROM n WHERE x IN ('general', 'public', 'mit', 'licens') GROUP BY id),
    m AS (SELECT d.id, day, coalesce(rank, 0) AS rank FROM d LEFT JOIN g USING (id) LEFT JOIN h USING (id) LEFT JOIN r USING (id) WHERE day >= DATE '2024-01-06' AND day <= DATE '2024-02-20' AND (g.id IS NOT NULL OR licens AND NOT mit OR source ILIKE '%src1%'))
    {_PAGE}""",
)
def fulltext_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase, or a word without another, or a source, in a window of days; ranked by how often words occur."""
    store, names = _texts(spark, sf)
    return _page(text_search.search(spark, store, '"general public" or licensing -mit', ["src1"], 150, names, "2024-01-06", "2024-02-20"))
