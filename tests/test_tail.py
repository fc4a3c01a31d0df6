"""The live tail against views of all events, and samples by turns against their rule."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import publishing, sampling
from tessera.streaming import tail

KINDS = ["run.created", "retrieval.completed", "answer.started", "other", "run.completed", "run.failed"]
SCHEMA = "run string, seq bigint, event string, at timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_views_are_the_same_after_any_cut(spark, tmp_path, seed):
    """Events come in any order, some twice, in batches of any size."""
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(12)}", seq, rng.choice(KINDS[: rng.choice([3, 4, 6])]), datetime(2024, 1, 1)) for seq in range(1, 200)]
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    source = tmp_path / "in"
    while rows:
        n = rng.choice([1, 5, 40, 90])
        spark.createDataFrame(rows[:n], SCHEMA).coalesce(1).write.mode("append").json(f"file://{source}")
        rows = rows[n:]
    whole = spark.read.schema(SCHEMA).json(f"file://{source}")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{source}")
    found = tail.views_available(tail.live_views(events, "run"), "run", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, publishing.run_views(whole, "run").collect()))
    # a restart with more events goes on from the state
    spark.createDataFrame([("r0", 500, "other", datetime(2024, 1, 1)), ("new", 1, "answer.started", datetime(2024, 1, 1))], SCHEMA).coalesce(1).write.mode("append").json(f"file://{source}")
    whole = spark.read.schema(SCHEMA).json(f"file://{source}")
    found = tail.views_available(tail.live_views(events, "run"), "run", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, publishing.run_views(whole, "run").collect()))
    assert sorted(r.seq for r in tail.after(whole, 190).select("seq").distinct().collect()) == [*range(191, 200), 500]


def test_silent_runs_expire(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    source = f"file://{tmp_path}/in"
    batches = [[("a", 1, "run.created", at(0)), ("b", 1, "run.completed", at(0))], [("c", 1, "run.created", at(500))], [("c", 2, "answer.started", at(501))], [("c", 3, "other", at(502))]]
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(SCHEMA).json(source)
    for rows in batches:  # a batch each, so that the watermark moves
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        views = tail.live_views(events, "run", "at", "1 minute", expires_ms=60_000)
        found = tail.views_available(views, "run", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted(map(tuple, found.collect())) == [("a", 1, "expired"), ("b", 1, "done"), ("c", 3, "answering")]


def sampled_one_by_one(rows, most):
    """The rule of turns: rows of (stratum, part, order, copies, id)."""
    strata = {}
    for s, p, o, c, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        strata.setdefault(s, {}).setdefault(p, []).append((c, i))
    queues = [[s, list(parts.items()), 0] for s, parts in strata.items()]
    seen, out, turn = set(), [], 0
    while len(out) < most:
        before = len(out)
        for q in queues:
            if len(out) == most:
                break
            s, parts, start = q
            for k in range(len(parts)):
                p, own = parts[(start + k) % len(parts)]
                own[:] = [x for x in own if x[0] not in seen]
                if own:
                    c, i = own.pop(0)
                    seen.add(c)
                    out.append((s, p, turn, i))
                    q[2] = (start + k + 1) % len(parts)
                    break
        if len(out) == before:
            break
        turn += 1
    return out


@pytest.mark.parametrize("values, most", [(40, 25), (15, 60), (400, 25)])
def test_turns_without_copies(spark, values, most):
    """With few values, one stratum's choice rules out others' again and again."""
    rng = random.Random(values)
    rows = [(rng.choice("abcd"), rng.choice("xyzuvw"), rng.randrange(50), f"v{rng.randrange(values)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, p string, score int, c string, id int").repartition(3)
    found = sampling.turns_without_copies(df, "s", "p", [F.desc("score"), F.col("id")], "c", most)
    assert [(r.s, r.p, r.turn, r.id) for r in found.collect()] == sampled_one_by_one([(s, p, (-o, i), c, i) for s, p, o, c, i in rows], most)
    assert sampling.turns_without_copies(df.limit(0), "s", "p", [F.col("id")], "c", most).count() == 0


def test_eval_sample_query(spark, sf):
    from tessera.plans import registry, shapes

    rows = [(r.lang, r.part, (-r.score, -r.size, r.doc_id), r.copies, r.doc_id) for r in shapes.eval_candidates(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert [tuple(r) for r in registry.queries()["eval_sample"](spark, sf).collect()] == sampled_one_by_one(rows, 60)
