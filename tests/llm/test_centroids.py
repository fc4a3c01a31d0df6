"""Centroid clustering against brute force with whole scans."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import centroids as C


def brute(rows, k=16, rounds=3, size=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    means = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    away = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    assign = lambda: [min((away(v, w), c) for c, w in enumerate(means)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(means)):
            own = [v for (_, v), (_, to) in zip(kept, at) if to == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    clip = lambda x: min(x, 2**63 - 1)
    inertia = {c: sum(d for d, to in at if to == c) for c in range(len(means))}
    sha = lambda c: hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()
    return sorted(((i, c, clip(d), clip(inertia[c]), clip(sum(inertia.values())), sha(c)) for (i, _), (d, c) in zip(kept, at)), key=str)


def found(df, **more):
    return sorted(map(tuple, C.cluster(df, **more).collect()), key=str)


def test_ties_repeats_and_odd_values(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(4)]) for i in range(400)]  # few places: ties and equal centroids
    rows += rows[:50] + [(7, [0.1] * 4), (None, [0.3, 0.2, 0.1, 0.0]), (None, [1.0] * 4)]
    rows += [(900, None), (901, [None] * 4), (902, [math.nan] * 4), (903, [math.inf, 0.0, 0.0, 0.0]), (904, [1.0] * 3), (905, []), (906, [-0.0, 1e-30, -1e-30, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    for k in (1, 2, 16, 60):
        assert found(df, k=k, size=4) == brute(rows, k, size=4)
    assert found(df, k=16, size=4, rounds=0) == brute(rows, 16, 0, size=4)


def test_large_values_and_few_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 3, 9, 15, 30]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found(df, k=5, size=3) == brute(rows, 5, size=3)
    assert found(df.where("vec_id < 3"), k=5, size=3) == brute(rows[:3], 5, size=3)
    assert C.cluster(df.limit(0), size=3).count() == 0
    assert C.cluster(df, size=64).count() == 0


def test_one_vector_is_a_third_of_all(spark):
    rng = random.Random(3)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df, size=8) == brute(rows, size=8)


def test_bounds_leave_out_most_centroids(monkeypatch):
    """Well parted groups: after the first round no more than the own centroid is compared."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-4000, 4000, (50, 16)).astype(float)
    x = np.floor(middles[np.arange(5000) % 50] + rng.normal(0, 20, (5000, 16)))
    now = C.Centroids([list(map(int, m)) for m in middles])
    cluster, upper, lower = np.zeros(5000, int), np.full(5000, np.inf), np.full(5000, -np.inf)
    now.assign(x, cluster, upper, lower)
    assert (cluster == np.arange(5000) % 50).all()
    seen = []
    plain = C.Centroids.squared
    monkeypatch.setattr(C.Centroids, "squared", lambda self, rows, *more: seen.append(len(rows)) or plain(self, rows, *more))
    moved = C.Centroids([[c + 1 for c in v] for v in now.vectors], now)
    moved.assign(x, cluster, upper, lower)
    assert sum(seen) < 5000  # of 250,000


def test_query_and_sql(spark, sf):
    from tessera.llm.queries import oracle_sql, op11_centroids

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = op11_centroids(spark, sf)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(oracle_sql()["op11_centroids"])
    assert [d[0] for d in want.description] == df.columns
    assert sorted(want.fetchall(), key=str) == got


@pytest.mark.parametrize("kind", [float, object])
def test_bounds_are_outward(kind):
    squares = np.array([0, 1, 2, 3, 10**12 + 1, 4 * 10**14 + 7], kind)
    assert all(int(s) <= u * u for s, u in zip(squares, map(float, C.up(squares))))
    assert all(d >= 0 and d * d <= int(s) for s, d in zip(squares, map(float, C.down(squares))))
