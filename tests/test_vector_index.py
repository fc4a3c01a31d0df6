"""The kept vector index: recall against whole scans, what is read, odd vectors, additions."""

import math

import numpy as np
import pytest

from tessera.operators import vector_index as V


def exact(rows, asked, k=10):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.stack([v / np.linalg.norm(v) for _, v in fine])
    out = {}
    for n in np.nonzero(np.isin(ids, asked))[0]:
        s = x @ x[n]
        s[ids == ids[n]] = -np.inf
        out[int(ids[n])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.id)
    return sum(len(set(w) & got.get(q, set())) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """20,000 vectors in 200 groups, a third of them one vector."""
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (200, 32))
    x = middles[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.5, (20_000, 32))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(6)
    store = f"file://{tmp_path_factory.mktemp('index')}/a"
    return df, rows, store, V.build(df, store, "id", "v", 32)


def test_recall_and_share_of_vectors_that_are_read(grouped):
    df, rows, store, about = grouped
    asked = [i for i in range(0, 20_000, 50) if i % 3]
    found = V.search(df.where("id % 50 = 0 and id % 3 <> 0"), store, "id", "v").collect()
    assert recall(found, exact(rows, asked)) >= 0.95
    assert about["recall"] >= 0.95 and about["probes"] < about["lists"] / 4 and about["rerank"] < 0.05 * len(rows)
    assert all(a.score >= b.score for a, b in zip(found, found[1:]) if a.query_id == b.query_id and a["rank"] < b["rank"])


def test_all_lists_and_all_vectors_are_exact(grouped):
    df, rows, store, about = grouped
    asked = [1, 50, 77, 100]
    found = V.search(df.where("id in (1, 50, 77, 100)"), store, "id", "v", probes=10**6, rerank=20_000).collect()
    want = exact(rows, asked)
    assert all([r.id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == want[q] for q in asked)


def test_waves(grouped, monkeypatch):
    df, _, store, _ = grouped
    some = df.where("id % 1000 = 1")
    want = sorted(map(tuple, V.search(some, store, "id", "v").collect()))
    monkeypatch.setattr(V, "WAVE_BYTES", 100_000)
    assert sorted(map(tuple, V.search(some, store, "id", "v").collect())) == want


def test_a_model_of_a_small_sample(grouped, spark, tmp_path, monkeypatch):
    df, rows, _, _ = grouped
    monkeypatch.setattr(V, "SAMPLE_BYTES", 2000 * 8 * 32)
    about = V.build(df, store := f"file://{tmp_path}/d", "id", "v", 32)
    asked = [i for i in range(0, 20_000, 500) if i % 3]
    assert recall(V.search(df.where("id % 500 = 0 and id % 3 <> 0"), store, "id", "v").collect(), exact(rows, asked)) >= 0.9 and about["recall"] >= 0.95


def test_odd_vectors_and_additions(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(40)]
    odd = [(None, [1.0] * 6), (100, None), (101, [0.0] * 6), (102, [1.0] * 5), (103, [math.nan] * 6), (104, [None] * 6), (105, [])]
    store = f"file://{tmp_path}/b"
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "id bigint, v array<double>, score string")
    V.build(df, store, "id", "v", 6)
    found = V.search(df, store, "id", "v", k=3).collect()
    assert {r.query_id for r in found} == set(range(40))
    more = spark.createDataFrame([(200, rows[0][1]), (201, [2 * x for x in rows[0][1]])], "id bigint, v array<double>")
    V.add(more, store, "id", "v")
    assert [(r.id, r.score) for r in V.search(df.where("id = 0"), store, "id", "v", k=2).orderBy("rank").collect()] == [(200, 1.0), (201, 1.0)]
    assert V.search(df.where("id = 0"), store, "id", "v", k=1, own=True).head().id == 0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    store = f"file://{tmp_path}/c"
    V.build(none, store, "id", "v", 4)
    assert V.search(none, store, "id", "v").count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id bigint, v array<double>")
    assert V.search(one, store, "id", "v").count() == 0


def test_query(spark, sf):
    from tessera.plans import registry

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = registry.queries()["vector_index_topk"](spark, sf).withColumnRenamed("vec_id", "id").collect()
    assert recall(found, exact(rows, [i for i, _ in rows if i % 50 == 0])) >= 0.95


def test_waves_bound_what_a_task_keeps(spark, monkeypatch, tmp_path):
    """Tasks hold no more than WAVE_BYTES of kept rows, however many are compared for a query, and the results are the same."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))], "id bigint, v array<double>")
    V.build(df, str(tmp_path / "index"), "id", "v", 8)
    find = lambda: sorted(map(tuple, V.search(df.where("id % 3 = 0"), str(tmp_path / "index"), "id", "v", 5, 4, 200).collect()))
    want, seen, kept = find(), [], V.Model.tables
    tables = 2 * 256 * 4  # of a query
    monkeypatch.setattr(V, "WAVE_BYTES", 100 * tables)
    monkeypatch.setattr(V.Model, "tables", lambda self, q: seen.append(len(q)) or kept(self, q))
    assert find() == want and len(want) == 500
    assert len(seen) > 1 and sum(seen) == 100
