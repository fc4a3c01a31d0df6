"""Quotes, markers and merged votes."""

from pyspark.sql import functions as F

from tessera.functions import quotes
from tessera.operators import votes


def test_quotes(spark):
    text = "He said: “We won’t leave — not now…” and left."
    rows = [(text, '"we won\'t leave - not now..."'), (text, "We will leave, not now"), (text, "left."), (text, None), (None, "a long enough quote"), ("ﬁne​ words  here and there", "fine words here")]
    df = spark.createDataFrame(rows, "t string, q string")
    assert [r.v for r in df.select(quotes.verified(F.col("t"), F.col("q")).alias("v")).collect()] == [True, False, False, False, False, True]


def test_markers(spark):
    df = spark.createDataFrame([("One [c2]. Two [c1][c2]! Three?",)], "a string")
    r = df.select(quotes.markers(F.col("a")).alias("m"), quotes.uncited_sentences(F.col("a")).alias("n")).head()
    assert r.m == [2, 1] and r.n == 1


def test_votes(spark):
    said = lambda text, *ids: (text, list(ids))
    rows = [(1, 0, "A", "strike", [said("x" * 10, 1, 2, 3)]), (1, 1, "B", "other", [said("b", 9)]), (2, 0, "A2", "strike", [said("x" * 30, 1, 2)]), (3, 2, "A3", "advance", [said("y" * 12, 2, 3), said("z" * 8, 4)])]
    runs = lambda n: spark.createDataFrame([("d", n)], "cell string, runs int")
    df = spark.createDataFrame([("d", *r) for r in rows], "cell string, vote int, place int, title string, kind string, claims array<struct<text: string, ids: array<bigint>>>")
    (m,) = votes.merged_votes(df, "cell", runs(3)).collect()
    assert (m.title, m.kind, m.votes, m.ids) == ("A3", "strike", 3, [1, 2, 3])
    assert [tuple(c) for c in m.claims] == [("y" * 12, [2, 3])]  # the middle's, without the claim that one run gave
    # two of five runs are no majority, whether the others gave events or none
    assert votes.merged_votes(df, "cell", runs(7)).count() == 0
    assert votes.merged_votes(df.limit(0), "cell", runs(3)).count() == 0


def merged_one_by_one(rows, runs):
    """The rule of merged votes, event after event: rows of (vote, place, title, kind, claims)."""
    needed, groups = runs // 2 + 1, []
    for v, p, title, kind, claims in sorted(rows, key=lambda r: r[:2]):
        ids = {i for _, own in claims for i in own}
        shares = [len(ids & g["held"]) / len(ids | g["held"]) if ids and g["held"] else 0 for g in groups]
        if shares and max(shares) >= 0.5:
            g = groups[shares.index(max(shares))]
        else:
            groups.append(g := {"held": set(), "events": []})
        g["held"] |= ids
        g["events"].append((sum(len(t) for t, _ in claims), v, p, title, kind, claims, ids))
    out = []
    for g in groups:
        events = sorted(g["events"], key=lambda e: e[:3])
        middle, voters = events[(len(events) - 1) // 2], {e[1] for e in events}
        ids = sorted(i for i in g["held"] if len({e[1] for e in events if i in e[6]}) >= needed)
        claims = [(t, [i for i in own if i in ids]) for t, own in middle[5]]
        claims = [c for c in claims if c[1]]
        kinds = [e[4] for e in events]
        if len(voters) >= needed and claims:
            kind = min(set(kinds), key=lambda k: (-kinds.count(k), k != middle[4], k))
            out.append((sum(e[2] for e in events) / len(events), -len(voters), ids[0], middle[3], kind, claims, ids))
    return [(title, kind, -n, mean, claims, ids) for mean, n, _, title, kind, claims, ids in sorted(out, key=lambda r: r[:3])[:12]]


def test_votes_against_one_by_one(spark):
    import random

    rng = random.Random(7)
    rows = []
    for cell in range(25):
        for v in range(5):
            for p in range(rng.randrange(6)):
                base = 10 * rng.randrange(3)
                claims = [("t" * rng.randrange(1, 9), rng.sample(range(base, base + 3), rng.randrange(0, 4))) for _ in range(rng.randrange(1, 3))]
                rows.append((cell, v, p, f"title {v} {p}", rng.choice("abc"), claims))
    df = spark.createDataFrame(rows, "cell int, vote int, place int, title string, kind string, claims array<struct<text: string, ids: array<bigint>>>").repartition(3)
    runs = spark.createDataFrame([(c, 5) for c in range(25)], "cell int, runs int")
    found = {}
    for r in sorted(votes.merged_votes(df, "cell", runs).collect(), key=lambda r: (r.cell, r.place)):
        found.setdefault(r.cell, []).append((r.title, r.kind, r.votes, r.mean_rank, [tuple(c) for c in r.claims], r.ids))
    want = {c: m for c in range(25) if (m := merged_one_by_one([r[1:] for r in rows if r[0] == c], 5))}
    assert found == want and len(want) > 10


def test_merged_votes_query(spark, sf):
    from tessera.plans import registry, values

    rows = values.vote_events(spark, sf).collect()
    want = {}
    for cell in {r.cell for r in rows}:
        own = [(r.vote, r.place, r.title, r.kind, [tuple(c) for c in r.claims]) for r in rows if r.cell == cell]
        if m := merged_one_by_one(own, 5):
            want[cell] = [(t, k, n, round(mean, 6), ids) for t, k, n, mean, _, ids in m]
    found = {}
    for r in sorted(registry.queries()["merged_votes"](spark, sf).collect(), key=lambda r: (r.cell, r.place)):
        found.setdefault(r.cell, []).append((r.title, r.kind, r.votes, r.mean_rank, r.ids))
    assert found == want and want


def test_publication(spark):
    from tessera.operators import answers

    rows = [
        ("X was convicted of fraud", True, "claimed", 1, "drop"),
        ("X was convicted of fraud", True, "claimed", 2, "attribute"),
        ("State media claims X was convicted of fraud", True, "claimed", 2, "publish"),
        ("X died, with reports suggesting an accident", True, "unverified", 3, "attribute"),
        ("X was killed", True, "confirmed", 1, "publish"),
        ("A depot was hit", False, "claimed", 1, "publish"),
    ]
    df = spark.createDataFrame(rows, "t string, p boolean, h string, n int, want string")
    got = df.select(answers.publication(F.col("t"), F.col("p"), F.col("h"), F.col("n")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_rerank_and_trim(spark):
    from tessera.operators import answers

    df = spark.createDataFrame([([1, 2, 3, 4], [4, 9, 4, 2]), ([1, 2, 3, 4], [9, 4])], "c array<int>, g array<int>")
    assert [r.x for r in df.select(answers.reranked(F.col("c"), F.col("g"), 3).alias("x")).collect()] == [[4, 2, 1], [1, 2, 3]]
    many = spark.createDataFrame([(list(range(20)), 3), (list(range(20)), 12), (list(range(20)), None)], "i array<int>, n int")
    assert [len(r.x) for r in many.select(answers.trimmed(F.col("i"), F.col("n")).alias("x")).collect()] == [8, 12, 20]


def test_gate_and_coverage(spark):
    from tessera.operators import answers

    old = spark.createDataFrame([(39.4, 69.2)], "recall_pct double, citation_pct double")
    new = spark.createDataFrame([(97.0, 96.9, 1.0)], "recall_pct double, citation_pct double, honesty double")
    assert answers.gate(old, new).head().passed and not answers.gate(old, new.withColumn("honesty", F.lit(0.5))).head().passed
    m = spark.createDataFrame([("d", 1, 5, 4), ("d", 9, 5, 4), ("d", None, 5, 4)], "k string, f int, p int, n int")
    assert tuple(answers.at_publish(m, ["k"], "f", "p", F.col("n")).head()) == ("d", 3, 1, 4, 25.0)
    c = spark.createDataFrame([(1, 0.9), (2, 0.7), (3, 0.4)], "id int, s double")
    assert [r.id for r in answers.related(c, c.where("id = 1"), "id", "s").collect()] == [2]
    assert answers.cells(spark.createDataFrame([("ru", ["a", "b"])], "country string, tracks array<string>")).count() == 2
