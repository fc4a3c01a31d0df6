"""A kept index for approximate nearest vectors by cosine: inverted lists, product-quantised residuals, exact scores of the best.

Built once: lists' centroids and the codes' letters are fitted on a bounded sample (SAMPLE_BYTES of vectors, by hashes of
their ids); then every vector is put in its nearest list with a code, one byte for each PART dimensions, of what its centroid leaves over. The table is
sorted by list and id, so a filter on lists skips row groups, and codes are read without their vectors. More vectors can be added later with the same model.

A search reads the codes of each query's nearest lists (`probes`), keeps the best `rerank` by their estimate, and reads and compares only these
vectors. How many lists and vectors that takes is measured when the index is built: for ASKED vectors, against a whole exact scan, for
doubled numbers of lists, with one pass over the codes; the cheapest pair that reaches the target recall is the index's default. Where vectors have no groups, as
independent random ones, that takes most lists; where they have, few.

Queries go in waves whose tables are WAVE_BYTES at most, as are the rows that a task keeps: `rerank` a query.

Vectors that are null, of another length, or without a finite direction (null or non-finite components, only zeros) take no part. Ties
go to smaller ids. An empty table makes an empty index, whose searches find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Of vectors that the model is fitted on, and of the tables of one wave of queries.
SAMPLE_BYTES, WAVE_BYTES = 64 << 20, 32 << 20
#: Lists at most; letters of a code; dimensions of a letter.
MOST_LISTS, LETTERS, PART = 4096, 256, 4
#: Vectors that are asked for to measure recall, and neighbours of each.
ASKED, NEAREST, TARGET = 64, 10, 0.97
ROUNDS, CHUNK = 8, 4096
ROWS = "list int, id bigint, code binary, v array<float>"
#: Bytes of a row that a task keeps for a query: score, id and list.
KEPT_BYTES = 16
FOUND = "number int, list int, id bigint, score double"


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c (Euclidean) to each row of x."""
    half, out = (c * c).sum(1) / 2, np.zeros(len(x), np.int32)
    for a in range(0, len(x), CHUNK):
        out[a : a + CHUNK] = (x[a : a + CHUNK] @ c.T - half).argmax(1)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


@dataclass
class Model:
    """Lists' centroids (lists x dimensions) and letters (parts x LETTERS x PART) of unit vectors."""

    dims: int
    lists: np.ndarray
    books: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, dims: int, count: int) -> Model:
        """count: how many vectors there are; as many lists as its root."""
        rng = np.random.default_rng(1)
        parts = -(-dims // PART)
        if not len(x):
            return Model(dims, np.zeros((1, dims), np.float32), np.zeros((parts, 1, PART), np.float32))
        lists = _means(x, max(1, min(MOST_LISTS, math.isqrt(count), len(x))), rng)
        rest = _cells(x - lists[_nearest(x, lists)])
        return Model(dims, lists, np.stack([_means(np.ascontiguousarray(rest[:, p]), min(LETTERS, len(x)), rng) for p in range(parts)]))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.lists)
        rest = _cells(x - self.lists[at])
        return at, np.stack([_nearest(np.ascontiguousarray(rest[:, p]), b).astype(np.uint8) for p, b in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with the lists' centroids, and with all letters of all parts."""
        return q @ self.lists.T, np.einsum("qpd,pld->qpl", _cells(q), self.books).astype(np.float32)


def _cells(x: np.ndarray) -> np.ndarray:
    """Rows x parts x PART, filled up with zeros."""
    parts = -(-x.shape[1] // PART)
    return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)


def _units(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _fit(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """id, v of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.size("v") == dims)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.where("id is not null").where(fine).where(length > 0)


def _estimates(model: Model, near: np.ndarray, letters: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Queries x rows: estimated products."""
    out = near[:, at].astype(np.float32)
    for p in range(codes.shape[1]):
        out += letters[:, p][:, codes[:, p]]
    return out


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _write(rows: DataFrame, model: Model, store: str, mode: str) -> None:
    spark = ship(rows.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _units(b.column(1), sent.value.dims)
            at, codes = sent.value.coded(x)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(ends, x.ravel())], ["list", "id", "code", "v"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.mapInArrow(run, ROWS).repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id")
    ordered.write.mode(mode).option("parquet.block.size", 16 << 20).parquet(f"{store}/rows")
    sent.unpersist()


def build(vectors: DataFrame, store: str, key: str, column: str, dims: int, target: float = TARGET) -> dict:
    """Writes an index and gives its defaults: probes, rerank and the recall that was measured."""
    spark = vectors.sparkSession
    rows = _fit(vectors, key, column, dims)
    most, count = max(LETTERS, SAMPLE_BYTES // (8 * dims)), rows.count()
    # a share of all hashes, so that no task sorts more than the sample
    some = rows if count <= most else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most / count)).limit(2 * most)
    sample = some.orderBy(F.xxhash64("id"), "id").toArrow()
    x = _units(sample.column("v").combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims), np.float32)
    model = Model.fitted(x, dims, count)
    _write(rows, model, store, "error")
    found = _tuned(spark, model, store, sample.column("id").to_numpy()[:ASKED] if len(x) else np.zeros(0, np.int64), x[:ASKED], target)
    about = [(dims, model.lists.tobytes(), model.books.tobytes(), model.books.shape[1], *(found[0][n] for n in ("probes", "rerank", "recall")))]
    spark.createDataFrame(about, "dims int, lists binary, books binary, letters int, probes int, rerank int, recall double").coalesce(1).write.parquet(f"{store}/model")
    return found[0] | {"others": found[1:], "lists": len(model.lists)}


def add(vectors: DataFrame, store: str, key: str, column: str) -> None:
    """More vectors for a kept index, under its model."""
    model, _ = opened(vectors.sparkSession, store)
    _write(_fit(vectors, key, column, model.dims), model, store, "append")


def opened(spark: SparkSession, store: str) -> tuple[Model, dict]:
    r = spark.read.parquet(f"{store}/model").head()
    model = Model(r.dims, np.frombuffer(r.lists, np.float32).reshape(-1, r.dims), np.frombuffer(r.books, np.float32).reshape(-1, r.letters, PART))
    return model, {"probes": r.probes, "rerank": r.rerank, "recall": r.recall}


def _exact(rows: DataFrame, q: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """number, id, score, v of the k best of all rows for each query, by a whole scan; each task gives k a query."""
    sent = rows.sparkSession.sparkContext.broadcast((q, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        best: list[list[tuple[float, int, list[float]]]] = [[] for _ in q]
        for b in batches:
            ids, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, q.shape[1])
            scores = q.astype(np.float64) @ x.T.astype(np.float64)
            scores[own[:, None] == ids] = -np.inf
            for n in range(len(q)):
                top = np.argpartition(-scores[n], min(k, len(ids)) - 1)[:k] if len(ids) else []
                best[n] = sorted([*best[n], *((-scores[n, i], int(ids[i]), x[i].tolist()) for i in top if scores[n, i] > -np.inf)])[:k]
        out = [(n, i, -s, v) for n, found in enumerate(best) for s, i, v in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float32())))], ["number", "id", "score", "v"])

    found = rows.select("id", "v").mapInArrow(run, "number int, id bigint, score double, v array<float>")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _tuned(spark: SparkSession, model: Model, store: str, own: np.ndarray, q: np.ndarray, target: float) -> list[dict]:
    """probes, rerank and recall, the cheapest first.

    One pass over the codes counts, for each true neighbour and each doubled number of lists, the vectors of these lists that are estimated to be nearer: that is
    the place up to which vectors must be compared to find it.
    """
    rows, n_lists = spark.read.schema(ROWS).parquet(f"{store}/rows"), len(model.lists)
    levels = [min(1 << i, n_lists) for i in range(n_lists.bit_length() + 1)]
    levels = sorted(set(levels))
    whole = {"probes": n_lists, "rerank": max(NEAREST, LETTERS), "recall": 1.0}
    truth = _exact(rows, q, own, NEAREST).collect() if len(q) else []
    if not truth:
        return [whole]
    numbers = np.array([r.number for r in truth])
    at, codes = model.coded(np.array([r.v for r in truth], np.float32))
    near, letters = model.tables(q)
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)  # of each list, for each query
    estimate = _estimates(model, near, letters, at, codes)[numbers, np.arange(len(truth))]
    sent = spark.sparkContext.broadcast((model, own, near, letters, np.searchsorted(levels, place + 1), numbers, estimate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own, near, letters, level, numbers, estimate = sent.value
        counts = np.zeros((len(numbers), len(levels)), np.int64)
        for b in batches:
            at, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            e = _estimates(model, near, letters, at, _codes(b.column(2), len(model.books)))
            e[own[:, None] == ids] = -np.inf
            for t, n in enumerate(numbers):
                counts[t] += np.bincount(level[n, at[e[n] > estimate[t]]], minlength=len(levels))
        t, l = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(l), pa.array(counts[t, l])], ["t", "l", "n"])

    ahead = np.zeros((len(truth), len(levels)), np.int64)
    for r in rows.select("list", "id", "code").mapInArrow(run, "t bigint, l bigint, n bigint").groupBy("t", "l").agg(F.sum("n").alias("n")).collect():
        ahead[r.t, r.l] = r.n
    ahead, held = ahead.cumsum(1), place[numbers, at]
    total, out = rows.count(), []
    for l, probes in enumerate(levels):
        needed = np.sort(np.where(held < probes, ahead[:, l] + 1, np.iinfo(np.int64).max))
        least = needed[math.ceil(target * len(truth)) - 1]
        if least < np.iinfo(np.int64).max:
            rerank = max(NEAREST, int(least))
            cost = total * probes / n_lists * len(model.books) + rerank * 4 * model.dims
            out.append({"probes": probes, "rerank": rerank, "recall": round(float((needed <= rerank).mean()), 4), "cost": cost})
    return [{k: v for k, v in o.items() if k != "cost"} for o in sorted(out, key=lambda o: o["cost"])] or [whole]


def _candidates(batches: Iterator[pa.RecordBatch], model: Model, own: np.ndarray, near: np.ndarray, letters: np.ndarray, asked: np.ndarray, rerank: int) -> Iterator[pa.RecordBatch]:
    """The task's `rerank` best estimates for each query among the lists that are asked for it."""
    n = n_queries = len(near)
    score, ids, lists = np.full((n, rerank), -np.inf, np.float32), np.zeros((n, rerank), np.int64), np.zeros((n, rerank), np.int32)
    for b in batches:
        for a in range(0, b.num_rows, CHUNK):
            part = b.slice(a, CHUNK)
            at, mine = part.column(0).to_numpy(), part.column(1).to_numpy()
            some = np.nonzero(asked[:, np.unique(at)].any(1))[0]
            if not len(some):
                continue
            e = _estimates(model, near[some], letters[some], at, _codes(part.column(2), len(model.books)))
            e[~asked[some][:, at] | (own[some, None] == mine)] = -np.inf
            worst = score[some].min(1)
            for row, n in enumerate(some):
                hit = np.nonzero((e[row] > -np.inf) & (e[row] >= worst[row]))[0]
                if len(hit):
                    every, named, held = np.append(score[n], e[row, hit]), np.append(ids[n], mine[hit]), np.append(lists[n], at[hit])
                    best = np.lexsort((named, -every))[:rerank]
                    score[n], ids[n], lists[n] = every[best], named[best], held[best]
    for a in range(0, n_queries, ASKED):  # few queries at a time, so that no copy of all is made
        number, place = np.nonzero(score[a : a + ASKED] > -np.inf)
        number += a
        columns = [pa.array(number, pa.int32()), pa.array(lists[number, place]), pa.array(ids[number, place]), pa.array(score[number, place], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["number", "list", "id", "score"])


def search(queries: DataFrame, store: str, key: str, column: str, k: int = NEAREST, probes: int | None = None, rerank: int | None = None, own: bool = False) -> DataFrame:
    """query_id, rank, id, score (cosine, six places) of about the k nearest vectors for each query. own: a query's own id is a candidate too."""
    spark = ship(queries.sparkSession)
    model, found = opened(spark, store)
    probes, rerank = min(probes or found["probes"], len(model.lists)), max(rerank or found["rerank"], k)
    asked = _fit(queries, key, column, model.dims).distinct()
    # of a query: its tables of letters, or what a task keeps of it, which grows with `rerank`
    waves = -(-asked.count() * max(len(model.books) * model.books.shape[1] * 4, rerank * KEPT_BYTES) // WAVE_BYTES)
    rows, out = spark.read.schema(ROWS).parquet(f"{store}/rows"), None
    for w in range(waves):
        part = (asked if waves == 1 else asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(waves)) == w)).orderBy("id").toArrow()
        if not part.num_rows:
            continue
        ids, q = part.column("id").to_numpy(), _units(part.column("v").combine_chunks(), model.dims)
        near, letters = model.tables(q)
        open_ = np.zeros(near.shape, bool)
        np.put_along_axis(open_, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        mine = np.full(len(ids), np.iinfo(np.int64).min) if own else ids
        sent = spark.sparkContext.broadcast((model, mine, near, letters, open_, rerank))
        wanted = np.nonzero(open_.any(0))[0].tolist()
        some = rows if len(wanted) == len(model.lists) else rows.where(F.col("list").isin(wanted))
        best = Window.partitionBy("number").orderBy(F.desc("score"), "id")
        close = some.select("list", "id", "code").mapInArrow(lambda b, sent=sent: _candidates(b, *sent.value), FOUND)
        close = close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rerank).select("number", "list", "id")
        asked_by = spark.sparkContext.broadcast((ids, q))

        def compared(batches: Iterator[pa.RecordBatch], sent=asked_by) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                n, x = b.column(0).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, q.shape[1])
                score = np.round((q[n].astype(np.float64) * x).sum(1), 6)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[n]), b.column(1), pa.array(score)], ["number", "query_id", "id", "score"])

        # a wave's candidates are WAVE_BYTES / (4 * letters * parts) queries' with `rerank` each
        met = some.select("list", "id", "v").join(F.broadcast(close), ["list", "id"]).select("number", "id", "v")
        scored = met.mapInArrow(compared, "number int, query_id bigint, id bigint, score double")
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
