"""Centroid clustering by Exponion search (operator 11).

A vector keeps its centroid's number, an upper bound of the distance to it and a lower bound of the distance to any other. When
centroids move, the bounds move with them. A vector whose upper bound is below its lower bound, or below half the way from its
centroid to the next one, keeps its centroid without any distance. Of the others, the upper bound is made exact; if that isn't enough, only centroids
in a ball around the vector's own are compared: those up to twice the upper bound and the distance to the centroid's next one away,
a prefix of the centroid's list of the others by distance. The nearest two, and all ties with them, are in it, as the radius is inclusive.
Bounds are floats rounded outward; comparisons that decide are of exact integers.

Vectors with their bounds are a table of the shared folder, rewritten in each round; sums change only by vectors that changed their
centroid. Each task holds the k centroids and k lists of k - 1 numbers: k and the dimensions are parameters, not data. Of the vectors,
the driver gets the k first centroids, then sums: one row for each centroid, dimension and power at most.

Results: vectors of exactly `size` components, none null or non-finite, take part; components are floor(scale * x), x as double (where that is
beyond a double, the vector takes no part). Repeated rows and rows with equal ids are vectors each; of equal ids, the smaller vector
comes first. A null id has no hash and comes last among first centroids. Fewer vectors than k: as many centroids. No vectors: no rows.
Vectors as near to several centroids go to the smallest number. Sizes of vectors are fixed, so none is long; distances and inertias beyond a long
are given as its bound. Other columns of the input aren't read, so no name can clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch

LONG = (1 << 63) - 1
#: Integers below it are exact as doubles.
EXACT = 1 << 53
#: Components below it are summed as longs within a batch.
SMALL = 1 << 40
STATE = "id bigint, v array<double>, cluster int, upper double, lower double, was int"


def up(squared: np.ndarray) -> np.ndarray:
    """Roots of exact squares, rounded up."""
    if squared.dtype == object:
        return np.array([math.nextafter(float(math.isqrt(s) + 1), math.inf) for s in squared], float)
    return np.nextafter(np.sqrt(squared), np.inf)


def down(squared: np.ndarray) -> np.ndarray:
    """Roots of exact squares, rounded down."""
    if squared.dtype == object:
        return np.array([math.inf if s == math.inf else max(0.0, math.nextafter(float(math.isqrt(s)), -math.inf)) for s in squared], float)
    return np.maximum(np.nextafter(np.sqrt(squared), -np.inf), 0)


class Centroids:
    """The centroids of a round, as exact integers, with what they moved since the one before."""

    def __init__(self, vectors: list[list[int]], before: Centroids | None = None):
        self.vectors = vectors
        self.most = max((abs(c) for v in vectors for c in v), default=0)
        k = len(vectors)
        away = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in vectors] for v in vectors]
        #: For each centroid the others, the next one first, and how far they are at least.
        self.order = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (away[i][j], j)) for i in range(k)]
        self.far = [down(np.array([away[i][j] for j in o], object)) for i, o in enumerate(self.order)]
        self.next_most = np.array([up(np.array([away[i][o[0]]], object))[0] if o else 0.0 for i, o in enumerate(self.order)])
        self.half = np.array([f[0] / 2 if len(f) else math.inf for f in self.far])
        moved = [sum((a - b) ** 2 for a, b in zip(v, w)) for v, w in zip(vectors, before.vectors)] if before else [0] * k
        self.moved = np.where(np.array(moved, object) == 0, 0.0, up(np.array(moved, object))) if k else np.zeros(0)
        self.others_moved = np.array([max((m for j, m in enumerate(self.moved) if j != i), default=0.0) for i in range(k)])

    def exact_as(self, x: np.ndarray) -> type:
        """float, where all squared distances of these vectors are exact in doubles, else object: Python's integers."""
        most = max(float(np.abs(x).max(initial=0)), float(self.most))
        return float if 4 * most * most * max(1, x.shape[1]) < EXACT else object

    def squared(self, x: np.ndarray, to: int, kind: type) -> np.ndarray:
        """The exact squared distances of vectors to a centroid."""
        if kind is float:
            d = x - np.array(self.vectors[to], float)
            return np.einsum("ij,ij->i", d, d)
        out = np.empty(len(x), object)
        out[:] = [sum((int(a) - b) ** 2 for a, b in zip(row, self.vectors[to])) for row in x.tolist()]
        return out

    def own(self, x: np.ndarray, cluster: np.ndarray, rows: np.ndarray, into: np.ndarray, kind: type) -> None:
        """into[rows] gets the exact squared distances to the rows' own centroids."""
        for a in np.unique(cluster[rows]).tolist():
            mine = rows[cluster[rows] == a]
            into[mine] = self.squared(x[mine], a, kind)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, whole: bool = False) -> np.ndarray:
        """Changes cluster and the bounds to those of these centroids; whole: gives all exact squared distances to them."""
        upper[:] = np.nextafter(upper + self.moved[cluster], np.inf)
        lower[:] = np.nextafter(lower - self.others_moved[cluster], -np.inf)
        kind = self.exact_as(x)
        exact = np.full(len(x), -1, kind)
        open_ = np.nonzero(~(upper < np.maximum(lower, self.half[cluster])))[0]
        self.own(x, cluster, open_, exact, kind)
        upper[open_] = up(exact[open_])
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], self.half[cluster[open_]]))]
        for a in np.unique(cluster[open_]).tolist():
            rows = open_[cluster[open_] == a]
            radius = np.nextafter(2 * upper[rows] + self.next_most[a], np.inf)
            inside = np.searchsorted(self.far[a], radius, "right")
            rows, inside = rows[np.argsort(-inside, kind="stable")], -np.sort(-inside)
            best, at, second = exact[rows], np.full(len(rows), a), np.full(len(rows), math.inf, kind)
            for place, j in enumerate(self.order[a][: inside.max(initial=0)]):
                n = int(np.searchsorted(-inside, -place, "left"))  # those with more than `place` centroids in their ball
                d = self.squared(x[rows[:n]], j, kind)
                nearer = ((d < best[:n]) | ((d == best[:n]) & (j < at[:n]))).astype(bool)
                second[:n] = np.where(nearer, best[:n], np.minimum(second[:n], d))
                best[:n], at[:n] = np.where(nearer, d, best[:n]), np.where(nearer, j, at[:n])
            cluster[rows], exact[rows] = at, best
            upper[rows], lower[rows] = up(best), down(second)
        if whole:
            self.own(x, cluster, np.nonzero((exact == -1).astype(bool))[0], exact, kind)
        return exact


def _floors(column: pa.Array, size: int, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) * scale)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _started(batches: Iterator[pa.RecordBatch], size: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Vectors before the first round: of centroid 0, without bounds."""
    for b in batches:
        x = _floors(b.column(1), size, scale)
        good = np.isfinite(x).all(1)
        x, n = x[good], int(good.sum())
        yield b.column(0).filter(pa.array(good)), x, np.zeros(n, int), np.full(n, math.inf), np.full(n, -math.inf), pa.nulls(n, pa.int32())


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    for b in batches:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        yield b.column(0), x, b.column(2).to_numpy().astype(int), b.column(3).to_numpy().copy(), b.column(4).to_numpy().copy(), b.column(2)


def _pass(found: Iterator, centroids: Centroids, last: bool) -> Iterator[pa.RecordBatch]:
    for ids, x, cluster, upper, lower, was in found:
        exact = centroids.assign(x, cluster, upper, lower, last)
        own = pa.array(cluster.astype(np.int32))
        if last:
            far = pa.array([min(int(d), LONG) for d in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, own, far], ["vec_id", "cluster", "distance"])
        else:
            yield pa.RecordBatch.from_arrays([ids, _lists(x), own, pa.array(upper), pa.array(lower), was], ["id", "v", "cluster", "upper", "lower", "was"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """What the task's vectors, which all changed their centroid, add to sums and counts (dimension -1): total times two to the power."""
    whole = np.zeros((k, size + 1), object)
    large: dict[tuple[int, int, int], int] = defaultdict(int)
    for b in batches:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        for column, sign in ((0, 1), (2, -1)):
            there = b.column(column).is_valid().to_numpy(zero_copy_only=False)
            cluster = b.column(column).fill_null(0).to_numpy()[there].astype(int)
            mine = x[there]
            huge = np.abs(mine) >= SMALL
            part = np.zeros((k, size + 1), np.int64)
            np.add.at(part, cluster, np.column_stack([np.where(huge, 0, mine), np.ones(len(mine))]).astype(np.int64))
            whole += sign * part.astype(object)
            for row, dim in zip(*np.nonzero(huge)):
                value = int(mine[row, dim])
                power = 32 * max(0, (value.bit_length() - 64) // 32)  # a double has no bits below
                large[int(cluster[row]), int(dim), power] += sign * (value >> power)
    out = [(c, d if d < size else -1, 0, int(v)) for (c, d), v in np.ndenumerate(whole) if v]
    out += [(*at, v) for at, v in large.items() if v]
    if out:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        columns = [*list(zip(*out))[:3], [Decimal(r[3]) for r in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["cluster", "dim", "power", "total"])


def _firsts(rows: DataFrame, k: int, size: int, scale: float, seed: str) -> list[list[int]]:
    """The vectors of the k smallest hashes, in their order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    best = rows.select(named.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return [[int(math.floor(x * scale)) for x in r.v] for r in best]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64, size: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector after so many rounds and a last assignment."""
    spark, made = vectors.sparkSession, "vec_id bigint, cluster int, distance bigint"
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < math.inf)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == size) & F.forall("v", fine))
    now, before, state = Centroids(_firsts(rows, k, size, scale, seed)), None, None
    if not now.vectors:
        return spark.createDataFrame([], f"{made}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for turn in range(rounds + 1):
        last, sent = turn == rounds, spark.sparkContext.broadcast(now)

        def run(batches, sent=sent, last=last, first=state is None):
            return _pass(_started(batches, size, scale) if first else _kept(batches, size), sent.value, last)

        source = rows if state is None else spark.read.schema(STATE).parquet(state)
        after = scratch(spark, "vectors")
        source.mapInArrow(run, made if last else STATE).write.parquet(after)
        sent.destroy()
        if state:
            delete(spark, state)
        state = after
        if last:
            break
        n = len(now.vectors)
        moved = spark.read.schema(STATE).parquet(state).where("was is null or was <> cluster").select("cluster", "v", "was")
        parts = moved.mapInArrow(lambda b, n=n: _sums(b, n, size), "cluster int, dim int, power int, total decimal(38,0)")
        for r in parts.groupBy("cluster", "dim", "power").agg(F.sum("total").alias("total")).collect():
            sums[r.cluster, r.dim] += int(r.total) << r.power
        means = [[sums[c, d] // sums[c, -1] for d in range(size)] if sums[c, -1] else v for c, v in enumerate(now.vectors)]
        now, before = Centroids(means, now), now
    found = spark.read.schema(made).parquet(state)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, min(s, LONG), min(sum(inertia.values()), LONG), ",".join(map(str, now.vectors[c]))) for c, s in sorted(inertia.items())]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, said string")
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2("said", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
