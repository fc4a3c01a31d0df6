"""Exact top-k search by inner product with a uniform threshold in three phases (operator 10).

A vector's dimensions are cut into SLICES lists; a score is the sum of the lists' parts. The shards of the candidates are the
input's partitions.

1. Each shard takes each list's k best parts of each query, scores these candidates whole, and sends the k best scores. The
   k-th best of all shards is a cutoff that is safe: k candidates reach it.
2. The cutoff goes to the shards. A score that reaches it has a part of a SLICES-th of it at least in some list: these
   candidates are collected, and no others can matter.
3. Their scores are resolved exactly; those that reach the cutoff, k a shard at most, are merged.

Queries are sent in waves of about WAVE, each one pass of both scans. Waves follow each other: of each, the results are written to
the shared folder and what was sent is dropped before the next one, so neither the driver nor the plan grows with the queries.

Results: integer components floor(scale * x), x as double. Vectors that are null or hold null or non-finite components, and
rows with a null id, take no part. Only vectors of the query's length are candidates, and none with its id. Rows that repeat
are candidates each; queries with equal ids and vectors are one. Ties go to smaller ids. Fewer than k candidates: all.
Scores beyond a long are given as its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SLICES = 4
#: Queries in one broadcast.
WAVE = 16_384
#: Rows and queries of one block of scores.
ROWS, QUERIES = 4096, 256
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)


def _vectors(column: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows of the vectors that take part, and their integer components."""
    values = column.flatten()
    size = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out = {}
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.nonzero(size == n)[0]
        m = x[starts[rows][:, None] + np.arange(n)]
        good = np.isfinite(m).all(1)
        out[n] = rows[good], np.floor(scale * m[good])
    return out


class Block:
    """Queries of one length; numbers are their places in the wave."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.numbers, self.ids, self.vectors = numbers, ids, vectors
        self.most = float(np.abs(vectors).max(initial=0))
        n = vectors.shape[1]
        self.cuts = [slice(n * k // SLICES, n * (k + 1) // SLICES) for k in range(SLICES)]

    def parts(self, vectors: np.ndarray, some: slice) -> np.ndarray:
        """Lists x rows x queries: the parts of the scores."""
        exact = self.most * float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1) * SLICES < EXACT
        a, b = (vectors, self.vectors[some]) if exact else (_integers(vectors), _integers(self.vectors[some]))
        return np.stack([a[:, c] @ b[:, c].T if c.stop > c.start else np.zeros((len(a), len(b)), a.dtype) for c in self.cuts])

    def own(self, ids: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of rows with the query's id."""
        mine = self.ids[some]
        order = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[order], mine, "left"), np.searchsorted(ids[order], mine, "right")
        return order[np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum())], np.repeat(np.arange(len(mine)), hi - lo)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def _blocks(wave: list[tuple[int, int, list[float]]]) -> list[Block]:
    out = []
    for n in sorted({len(v) for _, _, v in wave}):
        own = [w for w in wave if len(w[2]) == n]
        out.append(Block(np.array([w[0] for w in own]), np.array([w[1] for w in own], np.int64), np.array([w[2] for w in own], np.float64).reshape(len(own), n)))
    return out


def _scored(batches: Iterator[pa.RecordBatch], blocks: list[Block], scale: float):
    """Blocks of parts: (query numbers, candidate ids, parts with the query's own rows as -inf)."""
    for b in batches:
        ids = b.column(0)
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        found = _vectors(b.column(1), scale)
        for block in blocks:
            rows, vectors = found.get(block.vectors.shape[1], (np.zeros(0, int), None))
            for k in range(0, len(rows), ROWS):
                keep = there[rows[k : k + ROWS]]
                mine, part = ids[rows[k : k + ROWS][keep]], vectors[k : k + ROWS][keep]
                for q in range(0, len(block.numbers), QUERIES):
                    some = slice(q, q + QUERIES)
                    if len(mine):
                        yield block.numbers[some], mine, block.parts(part, some), block.own(mine, some)


def _first(batches: Iterator[pa.RecordBatch], wave: list, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Phase 1: each query's k best whole scores among the k best of each list."""
    best = np.full((len(wave), k), -np.inf, object)
    for numbers, ids, parts, own in _scored(batches, _blocks(wave), scale):
        whole = parts.sum(0)
        lists = parts.astype(np.float64)
        lists[:, own[0], own[1]] = -np.inf
        n = min(k, len(ids))
        rows = np.sort(np.concatenate([np.argpartition(-p, n - 1, axis=0)[:n] for p in lists]), axis=0)
        scores = np.take_along_axis(whole, rows, axis=0).astype(object)
        scores[1:][rows[1:] == rows[:-1]] = -np.inf  # a candidate counts once
        mine = np.zeros(whole.shape, bool)
        mine[own] = True
        scores[np.take_along_axis(mine, rows, axis=0)] = -np.inf
        best[numbers] = -np.sort(-np.concatenate([best[numbers], scores.T], axis=1), axis=1)[:, :k]
    kind = pa.schema([("number", pa.int64()), ("scores", pa.list_(pa.int64()))])
    rows = [(i, [_long(x) for x in r if x != -np.inf]) for i, r in enumerate(best)]
    rows = [r for r in rows if r[1]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def _long(x) -> int:
    return int(min(max(x, LONG[0]), LONG[1]))


def _rest(batches: Iterator[pa.RecordBatch], wave: list, cutoffs: dict[int, int], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: candidates with a sufficient part, their whole scores, and of these the k best that reach the cutoff."""
    lowest = LONG[0]
    cut = np.array([cutoffs.get(i, lowest) for i in range(len(wave))], object)
    kept: dict[int, list[tuple[int, int]]] = {}
    for numbers, ids, parts, own in _scored(batches, _blocks(wave), scale):
        need = cut[numbers] if parts.dtype == object else cut[numbers].astype(np.float64)
        enough = (parts * SLICES >= need).any(0).astype(bool) | (cut[numbers] <= lowest).astype(bool)
        enough[own] = False
        row, query = np.nonzero(enough)
        score = parts[:, row, query].sum(0)
        if score.dtype == object:
            score = np.array([_long(x) for x in score] + [None], object)[:-1]
        reach = score >= need[query]
        row, query, score = row[reach], query[reach], score[reach]
        order = np.lexsort((ids[row], -score, query)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (query[i], -score[i], ids[row[i]])), int)
        row, query, score = row[order], query[order], score[order]
        starts = np.concatenate([[0], np.nonzero(np.diff(query))[0] + 1]) if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        for i in np.nonzero(place < k)[0].tolist():
            kept.setdefault(int(numbers[query[i]]), []).append((-_long(score[i]), int(ids[row[i]])))
        for n in set(numbers[query[place < k]].tolist()):
            kept[n] = sorted(kept[n])[:k]
    kind = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    out = [(n, wave[n][1], i, -s) for n, found in kept.items() for s, i in found]
    for a in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 50_000]), kind)], schema=kind)


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all vectors for each one where queries holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = vectors.where(queries).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.where("id is not null and v is not null").distinct()
    waves = -(-asked.count() // WAVE)
    schema, to = "query_id bigint, rank int, vec_id bigint, score bigint", scratch(spark, "top-k")
    for w in range(waves):
        part = asked if waves == 1 else asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(waves)) == w)
        wave = []
        for r in sorted(part.collect(), key=lambda r: (r.id, len(r.v), str(r.v))):
            if all(x is not None and np.isfinite(x) for x in r.v):
                wave.append((len(wave), r.id, np.floor(scale * np.array(r.v, np.float64)).tolist()))
        sent = spark.sparkContext.broadcast(wave)
        first = rows.mapInArrow(lambda b, sent=sent: _first(b, sent.value, k, scale), "number bigint, scores array<bigint>")
        merged = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
        cutoffs = first.groupBy("number").agg(merged.alias("s")).where(F.size("s") >= k).select("number", F.element_at("s", k).alias("cut"))
        cut = spark.sparkContext.broadcast({r.number: r.cut for r in cutoffs.collect()})
        rest = rows.mapInArrow(lambda b, sent=sent, cut=cut: _rest(b, sent.value, cut.value, k, scale), "number bigint, query_id bigint, vec_id bigint, score bigint")
        best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        ranked = rest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if waves == 1:
            return ranked
        ranked.write.parquet(f"{to}/wave={w}")
        sent.destroy()
        cut.destroy()
    return spark.read.schema(schema).parquet(to).select("query_id", "rank", "vec_id", "score") if waves else spark.createDataFrame([], schema)
