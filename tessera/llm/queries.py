"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Ends each document in token files.
END_ID = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, vocabulary()).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files as files

    folder, made = files.write(table(spark, sf_dir, "documents"), vocabulary(), END_ID)
    return files.read_digests(spark, folder, files.offsets(made)).withColumnRenamed("key", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicate

    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.getField("name"))))
    least = F.array_min(F.transform("licenses", lambda x: x.getField("differing")))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_finds"), F.array_join(names, ",").alias("names"), least.alias("least_differing"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc_mod("doc_id", 7) == 2, F.lit(False))
    found = score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    found = warc.read(spark, *warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc_mod("doc_id", 4) == 2, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, scale=64, size=64)


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
u AS (
  SELECT line, count(*) AS n, min(struct_pack(a := doc_id, b := i)) AS first, octet_length(encode(line)) AS size
  FROM l WHERE trim(line, ' ') <> '' GROUP BY line
), late AS (
  SELECT DISTINCT y.line FROM u x JOIN u y ON x.first < y.first AND x.size BETWEEN y.size - 2 AND y.size + 2
  WHERE x.size >= 20 AND y.size >= 20 AND levenshtein(x.line, y.line) <= CASE WHEN least(x.size, y.size) >= 40 THEN 2 ELSE 1 END
), m AS (
  SELECT l.doc_id, l.i, l.line, late.line IS NOT NULL AS near,
    late.line IS NULL AND u.line IS NOT NULL AND struct_pack(a := l.doc_id, b := l.i) <> u.first AS exact
  FROM l LEFT JOIN u ON l.line = u.line LEFT JOIN late ON l.line = late.line
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE near) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT exact AND NOT near), '') AS text
  FROM m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(g.text) AS text_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _rounds_sql(rounds: int) -> str:
    """Assignments and centroids of each round, then the last assignment."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS (
  SELECT i, q, CAST(c AS INTEGER) AS cluster, d AS distance FROM (
    SELECT v.i, v.q, k.c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN k{r} k
  ) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1
)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (
  SELECT cluster, list(CAST(s // n AS BIGINT) - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY dim) AS q FROM (
    SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS dim FROM a{r}) GROUP BY cluster, dim
  ) GROUP BY cluster
), k{r + 1} AS (SELECT k.c, coalesce(m.q, k.q) AS q FROM k{r} k LEFT JOIN m{r} m ON k.c = m.cluster)""")
    return ",".join(parts)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v)
  QUALIFY c < 16
), {_rounds_sql(3)}, s AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT v.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, s.cluster_inertia,
  CAST((SELECT sum(distance) FROM a3) AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (i) JOIN s USING (cluster) JOIN k3 k ON k.c = a.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op8_warc": OP8_SQL, "op10_topk": OP10_SQL, "op11_centroids": OP11_SQL}
