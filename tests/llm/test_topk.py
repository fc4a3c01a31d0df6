"""Top-k search against brute force."""

import math
import random

from pyspark.sql import functions as F

from tessera.llm import topk as K


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
    out = []
    for i, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        found = sorted((-clip(sum(a * b for a, b in zip(v, w))), j) for j, w in whole if j != i and len(w) == len(v))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def test_ties_odd_values_and_lengths(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, None if i % 17 == 3 else [rng.choice([0.5, -0.25, 1.0, 0.0]) for _ in range(6 if i % 9 else 3)]) for i in range(300)]
    rows[5], rows[7], rows[9], rows[10] = (5, [math.nan] * 6), (7, [None] * 6), (None, [1.0] * 6), (10, [])
    rows += [rows[0], rows[50], (100, [1e30] * 6), (1, [-1e30] * 6), (150, []), (200, [math.inf] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    assert sorted(map(tuple, K.search(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows)
    monkeypatch.setattr(K, "WAVE", 2)
    assert sorted(map(tuple, K.search(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows)


def test_floats_and_few_candidates(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(53)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.search(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows)
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, K.search(few, F.col("vec_id") % 50 == 0).collect())) == brute(rows[:3])
    assert K.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query(spark, sf):
    from tessera.llm.queries import op10_topk, table

    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op10_topk(spark, sf).collect()) == brute(rows)


def test_many_waves_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(K, "WAVE", 3)
    rng = random.Random(6)
    rows = [(50 * (i % 2), [rng.random() for _ in range(40)]) for i in range(30)] + [(i, [rng.random() for _ in range(40)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.search(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows)
