"""Operators on small tables, with the behaviours that the inventory names."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import claims, entities, html_reports, keyed, near_duplicates, retrieval, sampling, signals, star_blocks, trade, validation
from tessera.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_merges_by_key(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, w int")
    new = spark.createDataFrame([("b", None, 5), ("c", 3, 3)], "k string, v int, w int")
    assert rows(keyed.upsert(old, new, ["k"])) == [("a", 1, 1), ("b", None, 5), ("c", 3, 3)]
    assert rows(keyed.upsert(old, new, ["k"], keep_old=True)) == [("a", 1, 1), ("b", 2, 5), ("c", 3, 3)]
    assert rows(keyed.additive_upsert(old, new, ["k"], ["w"])) == [("a", 1), ("b", 7), ("c", 3)]
    assert rows(keyed.insert_ignore(old, new.unionByName(new), ["k"], [F.col("v")])) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 3)], "src int, dst int")
    assert rows(keyed.repoint(edges, spark.createDataFrame([(3, 1)], "from_id int, into_id int"))) == [(1, 2), (2, 1)]
    assert rows(keyed.orphans(spark.range(4), "id", (edges, "src"), (edges, "dst"))) == [(0,)]


def test_terminal_states_stay(spark):
    events = spark.createDataFrame([("r", 1, "started"), ("r", 2, "failed"), ("r", 3, "running"), ("s", 1, "started"), ("s", 2, "running")], "run string, seq int, state string")
    assert rows(keyed.last_state(events, "run", "state", ["seq"], ["failed", "done"])) == [("r", "failed"), ("s", "running")]


def test_upper_median_is_not_the_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0)] + [("b", 5.0), ("b", None)], "k string, v double")
    assert rows(validation.upper_median(df, ["k"], "v", "m")) == [("a", 2.0), ("b", 5.0)]
    assert rows(validation.upper_median(df.where("v <> 2"), ["k"], "v", "m")) == [("a", 9.0), ("b", 5.0)]


def test_majority_needs_over_half(spark):
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "k string, c string")
    assert rows(validation.majority(votes, ["k"], "c")) == [("a", "x", 2)]


def test_every_nth(spark):
    df = spark.range(103).repartition(7)
    assert sorted(r.id for r in sampling.every_nth(df, "id", 10).collect()) == list(range(0, 103, 10))


def test_every_nth_where_partitions_are_cut_anew(spark):
    """Wide rows and narrow counts: the plan that counts and the one that numbers may coalesce in other ways."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        df = spark.range(20_000).selectExpr("id", "repeat('x', 50) AS a", "id * 2 AS b", "uuid() AS c").repartition(9)
        assert sorted(r.id for r in sampling.every_nth(df, "id", 100).collect()) == list(range(0, 20_000, 100))
        assert [r.n for r in sampling.numbered(df, "id", "n", 5).orderBy("id").select("n").collect()] == list(range(5, 20_005))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_documents_without_text_are_their_own(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a b c d"), (4, "a  b c d"), (5, "")], "id int, t string")
    want = [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)]
    assert rows(near_duplicates.exact_mirrors(df, "id", "t")) == want
    assert rows(near_duplicates.near_mirrors(df, "id", "t")) == want


def gate_one_by_one(docs, threshold=0.7):
    """The rule of the gate, document after document."""
    rows_ = near_duplicates.HASHES // near_duplicates.BANDS
    accepted, out = [], {}
    for key, text, day, cell, ref in sorted(docs, key=lambda d: (not d[4], d[0])):
        squeezed = " ".join(text.split())
        words = "".join(c if c.isalnum() or c == " " else " " for c in text.lower()).split()
        sig = near_duplicates.signature(near_duplicates.runs_of(words))
        near = [a for a in accepted if a[3] == cell and abs((a[2] - day).days) <= 1]
        hit = next((a for a in near if a[1] == squeezed), None)
        if hit and not ref:
            out[key] = (hit[0], "exact")
            continue
        found = None
        for b in range(near_duplicates.BANDS):
            part = slice(b * rows_, (b + 1) * rows_)
            found = found or next((a for a in near if (a[4][part] == sig[part]).all() and (a[4] == sig).mean() >= threshold), None)
        if found and not ref:
            out[key] = (found[0], "minhash")
        else:
            out[key] = (key, "canonical")
            accepted.append((key, squeezed, day, cell, sig))
    return out


def test_gate_against_one_by_one(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, docs = [[word() for _ in range(40)] for _ in range(5)], []
    for k in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            own[rng.randrange(40)] = word()
        docs.append((k, rng.choice([" ", "  "]).join(own), datetime(2024, 1, 1 + rng.randint(0, 4)).date(), rng.choice(["ru", "ua"]), rng.random() < 0.1))
    df = spark.createDataFrame(docs, "id int, t string, d date, cell string, ref boolean")
    found = near_duplicates.gate(df, "id", "t", "d", "cell", "ref").collect()
    assert {r.id: (r.canonical, r.method) for r in found} == gate_one_by_one(docs)
    assert near_duplicates.gate(df.limit(0), "id", "t", "d", "cell", "ref").count() == 0


@pytest.mark.parametrize("in_task", [near_duplicates.IN_TASK, 40, 0])
def test_first_in_order(spark, monkeypatch, in_task):
    monkeypatch.setattr(near_duplicates, "IN_TASK", in_task)
    rng = random.Random(4)
    pairs = {(k, k + 1) for k in range(60)} | {tuple(sorted(rng.sample(range(100, 200), 2))) for _ in range(150)}
    node = lambda k: (k % 3 > 0, k)
    pairs = sorted(tuple(sorted((node(a), node(b)))) for a, b in pairs)
    links = spark.createDataFrame([(dict(late=a[0], key=a[1]), dict(late=b[0], key=b[1])) for a, b in pairs], "o_first struct<late: boolean, key: bigint>, o_second struct<late: boolean, key: bigint>")
    taken = set()
    for o in sorted({o for p in pairs for o in p}):
        if not any(b == o and a in taken for a, b in pairs):
            taken.add(o)
    found = [(r.o.late, r.o.key) for r in near_duplicates.first_in_order(links.repartition(3)).collect()]
    assert sorted(found) == sorted(taken)


def first_seen_one_by_one(docs, threshold=0.7):
    """The rule of groups by the first seen, document after document."""
    size = near_duplicates.HASHES // near_duplicates.BANDS
    signatures, canonical, buckets = {}, {}, {}
    for key, text in sorted(docs):
        if text is None:
            canonical[key] = key
            continue
        words = "".join(c if c.isalnum() or c == " " else " " for c in text.lower()).split()
        sig = signatures[key] = near_duplicates.signature(near_duplicates.runs_of(words))
        met = []
        for b in range(near_duplicates.BANDS):
            bucket = buckets.setdefault((b, *sig[b * size : (b + 1) * size].tolist()), [])
            met += [j for j in bucket if j not in met]
            bucket.append(key)
        canonical[key] = next((canonical[j] for j in met if (signatures[canonical[j]] == sig).mean() >= threshold), key)
    return canonical


@pytest.mark.parametrize("in_task", [near_duplicates.IN_TASK, 30, 0])
def test_first_seen_against_one_by_one(spark, monkeypatch, in_task):
    monkeypatch.setattr(near_duplicates, "IN_TASK", in_task)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [[word() for _ in range(40)] for _ in range(3)]
    docs = [(900, None), (901, ""), (902, ""), (903, "one two")]
    for k in range(120):  # copies of copies: chains in which the canonical is far from the candidate
        own = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(40)] = word()
        texts.append(own)
        docs.append((k, " ".join(own)))
    df = spark.createDataFrame(docs, "id bigint, t string").repartition(3)
    found = {r.id: r.canonical for r in near_duplicates.first_seen_groups(df, "id", "t").collect()}
    want = first_seen_one_by_one(docs)
    assert found == want and 10 < len(set(want.values())) < 100
    if in_task > 30:
        assert near_duplicates.first_seen_groups(df.limit(0), "id", "t").count() == 0


def test_first_seen_query(spark, sf):
    from tessera.plans import registry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.canonical for r in registry.queries()["first_seen_groups"](spark, sf).collect()} == first_seen_one_by_one(docs)


def test_gate_keeps_documents_without_text_or_day(spark):
    df = spark.createDataFrame([(1, "a b c", datetime(2024, 1, 1).date()), (2, None, datetime(2024, 1, 1).date()), (3, "a b c", None), (4, "a b c", datetime(2024, 1, 1).date())], "id int, t string, d date").withColumn("cell", F.lit("x"))
    assert rows(near_duplicates.gate(df, "id", "t", "d", "cell").select("id", "canonical", "method")) == [(1, 1, "canonical"), (2, 2, "canonical"), (3, 3, "canonical"), (4, 1, "exact")]


def stars_one_by_one(rows, dated, threshold=0.35):
    """The rule of star clusters, claim after claim: rows of (id, tokens, entities, hints, day)."""
    often, anchors, out = max(20, -(-len(rows) // 4)), {}, {}
    having = {}
    for i, t, e, h, d in sorted(rows, key=lambda r: r[0]):
        t, e, h = (set(x) if not dated or d is not None else set() for x in (t, e, h))
        keys = {("t", x) for x in t} | {("e", x) for x in e}
        best = (threshold - 1e-300, 0, None)
        for a in sorted({a for k in keys if len(having.get(k, ())) <= often for a in having.get(k, ())}):
            ot, oe, oh, od = anchors[a]
            if dated and abs((od - d).days) > 1:
                continue
            total = weight = 0.0
            for w, x, y in ((0.6, t, ot), (0.25, e, oe), (0.15, h, oh)):
                if w == 0.6 or (x and y):
                    total += w * (len(x & y) / len(x | y) if x | y else 0.0)
                    weight += w
            if total / weight >= threshold and (best[2] is None or total / weight > best[0]):
                best = (total / weight, 0, a)
        if best[2] is None:
            anchors[i] = (t, e, h, d)
            for k in keys:
                having.setdefault(k, []).append(i)
        out[i] = i if best[2] is None else best[2]
    return out


def test_stars_do_not_chain(spark):
    chain = [(i + 1, list(x)) for i, x in enumerate(["abcd", "bcde", "cdef", "defg"])] + [(9, ["x", "y"]), (10, ["p", "q"]), (11, []), (12, None)]
    df = spark.createDataFrame([("c", *r) for r in chain], "cell string, id int, t array<string>")
    found = {r.id: r.anchor for r in claims.star_clusters(df, ["cell"], "id", "t", threshold=0.5).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9, 10: 10, 11: 11, 12: 12}
    assert claims.star_clusters(df.limit(0), ["cell"], "id", "t").count() == 0


@pytest.mark.parametrize("seed, letters, in_task", [(1, 8, None), (2, 30, None), (3, 12, 5)])
def test_stars_against_one_by_one(spark, monkeypatch, seed, letters, in_task):
    """Few letters: most keys are frequent, and end to be of use while claims come."""
    if in_task is not None:
        monkeypatch.setattr(near_duplicates, "IN_TASK", in_task)
        monkeypatch.setattr(claims, "SMALL_CELL", 500)
    rng = random.Random(seed)
    pick = lambda most, n=letters: [f"w{rng.randrange(n)}" for _ in range(rng.randrange(most))]
    day = lambda: rng.choice([None, *(datetime(2024, 1, d).date() for d in (1, 2, 3))])
    rows_ = [(c, x, i, pick(7), rng.choice([None, pick(3, 4)]), pick(3), day()) for i, (c, x) in enumerate((rng.choice("ab"), rng.choice(["x", None])) for _ in range(500))]
    df = spark.createDataFrame(rows_, "c string, x string, id bigint, t array<string>, e array<string>, h array<string>, d date").repartition(3)
    cells = {(r[0], r[1]) for r in rows_}
    for dated, hints in ((True, "h"), (False, None)):
        found = {r.id: r.anchor for r in claims.star_clusters(df, ["c", "x"], "id", "t", "e", hints, "d" if dated else None).collect()}
        want = {}
        for cell in cells:
            want |= stars_one_by_one([(i, t, e or [], h if hints else [], d) for c, x, i, t, e, h, d in rows_ if (c, x) == cell], dated)
        assert found == want


@pytest.mark.parametrize("seed, letters, in_order", [(1, 8, 4096), (2, 30, 40), (3, 12, 16)])
def test_stars_by_blocks_against_one_by_one(spark, monkeypatch, seed, letters, in_order):
    """Cells in which claims meet anchors only: few or many decided at once, in groups of few claims."""
    for name, value in (("SMALL_CELL", 3), ("LONG_CLAIM", -1)):
        monkeypatch.setattr(claims, name, value)
    for name, value in (("BLOCK", 4), ("AT_ONCE", 7), ("IN_ORDER", in_order), ("GROUP", 40)):
        monkeypatch.setattr(star_blocks, name, value)
    rng = random.Random(seed)
    pick = lambda most, n=letters: [f"w{rng.randrange(n)}" for _ in range(rng.randrange(most))]
    day = lambda: rng.choice([None, *(datetime(2024, 1, d).date() for d in (1, 2, 3))])
    rows_ = [("a", rng.choice(["x", "x", "x", None]), f"{i:03}", pick(7), rng.choice([None, pick(3, 4)]), pick(3), day()) for i in range(240)]
    df = spark.createDataFrame(rows_, "c string, x string, id string, t array<string>, e array<string>, h array<string>, d date").repartition(3)
    for dated, hints in ((True, "h"), (False, None)):
        found = {r.id: r.anchor for r in claims.star_clusters(df, ["c", "x"], "id", "t", "e", hints, "d" if dated else None).collect()}
        want = {}
        for cell in {(r[0], r[1]) for r in rows_}:
            want |= stars_one_by_one([(i, t, e or [], h if hints else [], d) for c, x, i, t, e, h, d in rows_ if (c, x) == cell], dated)
        assert found == want


def test_star_query_leaves_out_no_pair(spark, tmp_path):
    """Documents of a source and language meet however far apart their ids are."""
    from tessera.plans import registry

    docs = [(i, f"one two three four {'five six' if i % 2 else 'nine ten'}", "en", "s", 30) for i in (0, 2, 700, 90_001)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.anchor for r in registry.queries()["star_clusters"](spark, str(tmp_path)).collect()} == {0: 0, 2: 0, 700: 0, 90_001: 0}


def test_stars_of_a_large_cell(spark):
    """A cell of 100,000 claims of words of which some are very frequent: one claim in four rewords the one before it."""
    word = lambda n, k: F.concat(F.lit(f"w{k}-"), F.floor(F.pow(F.pmod(F.xxhash64(F.lit(k), n), F.lit(10**6)) / 1e6, 3) * 20_000))
    n = F.col("id") - F.when(F.col("id") % 4 == 3, 1).otherwise(0)
    df = spark.range(100_000).select(F.lit("c").alias("cell"), "id", F.array(*[word(n, k) for k in range(9)], word(F.col("id"), 9)).alias("t"))
    found = claims.star_clusters(df, ["cell"], "id", "t")
    assert found.where("id % 4 = 3 AND anchor <> id").count() >= 24_990 and found.count() == 100_000


def mixed_one_by_one(docs, most, fraction):
    """The rule of mixes for a best-first list of (id, adapter, platform)."""
    if fraction >= 1:
        return [d[0] for d in docs[:most]]
    cap = max(1, -int(-most * fraction // 1))
    alternated = lambda some: [d for _, _, d in sorted((sum(o[1] == d[1] for o in some[:k]), k, d) for k, d in enumerate(some))]
    taken, passed = [], []
    for d in docs:
        fits = len(taken) < most and all(sum(t[n] == d[n] for t in taken) < cap for n in (1, 2))
        (taken if fits else passed).append(d)
    taken = sorted(taken + alternated(passed)[: most - len(taken)], key=docs.index)
    return [d[0] for d in alternated(taken)]


def test_source_mix(spark):
    rng = random.Random(8)
    rows_ = [(rng.choice(["x", "y", None]), i, rng.choice("aaaabbc"), rng.choice(["p", "p", "q", "r"]), rng.randrange(9)) for i in range(300)]
    rows_ += [("z", 1000 + i, "a", "p", 5) for i in range(8)] + [("z", 1008, "b", "q", 1), ("z", 1009, None, None, 0)]
    df = spark.createDataFrame(rows_, "cell string, id int, a string, p string, score int")
    for most, fraction in ((5, 0.4), (40, 0.4), (12, 0.1), (7, 1.0), (1, 0.4)):
        found = {}
        for r in claims.source_mix(df, ["cell"], "id", "a", "p", [F.desc("score"), F.col("id")], most, fraction).orderBy("cell", "place").collect():
            found.setdefault(r.cell, []).append(r.id)
        for cell in ("x", "y", None, "z"):
            best = sorted((r for r in rows_ if r[0] == cell), key=lambda r: (-r[4], r[1]))
            assert found[cell] == mixed_one_by_one([(r[1], r[2] or "unknown", r[3] or "unknown") for r in best], most, fraction)


def test_star_and_mix_queries(spark, sf):
    from tessera.functions.text import is_meta_claim
    from tessera.plans import analytics, registry

    kept = analytics.claims_of_documents(spark, sf).where(~is_meta_claim(F.coalesce("text", F.lit("")))).collect()
    cells, want = {}, {}
    for r in kept:
        cells.setdefault((r.source, r.lang, r.window), []).append((r.doc_id, r.tokens or [], r.actors or [], [], r.day))
    for own in cells.values():
        want |= stars_one_by_one(own, True)
    assert {r.doc_id: r.anchor for r in registry.queries()["star_clusters"](spark, sf).collect()} == want
    docs, found = spark.read.parquet(f"{sf}/documents.parquet").collect(), {}
    for r in registry.queries()["source_mix"](spark, sf).orderBy("lang", "place").collect():
        found.setdefault(r.lang, []).append(r.doc_id)
    for lang in {r.lang for r in docs}:
        best = sorted((r for r in docs if r.lang == lang), key=lambda r: (-r.n_chars, r.doc_id))
        assert found[lang] == mixed_one_by_one([(r.doc_id, r.source or "unknown", "long" if r.n_chars > 1000 else "short") for r in best], 120, 0.4)


def fnv(s, i):
    h = (0x811C9DC5 ^ (i * 0x9E3779B9 & 0xFFFFFFFF)) & 0xFFFFFFFF
    units = s.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return h


def test_signatures_are_the_defined_ones():
    some = ["a b c", "é ü 🙂", "longer words here"]
    assert near_duplicates.signature(some).tolist() == [min(fnv(s, i) for s in some) for i in range(64)]
    assert (near_duplicates.signature([]) == np.uint32(0xFFFFFFFF)).all()


def test_near_mirrors(spark):
    base = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(3, base), (1, base + " more"), (2, base.upper()), (4, "something else entirely, here"), (5, " ".join(reversed(base.split())))], "id bigint, text string")
    assert rows(near_duplicates.near_mirrors(df, "id", "text")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    pairs = {(r.left, r.right) for r in near_duplicates.shingle_pairs(df, "id", "text").collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}


def test_trade(spark):
    flows = spark.createDataFrame([("x", "2021", 6e6), ("x", "2024", 2e7), ("x", "2025", 1e3), ("y", "2021", 1e3), ("y", "2025", 9e6), ("z", "2021", 6e6), ("z", "2025", 7e6)], "k string, year string, usd double")
    found = {r.k: r for r in trade.divergence(flows, ["k"], "year", "usd", "2021").collect()}
    assert (found["x"].latest_year, found["x"].multiple, found["x"].flagged) == ("2024", 3.33, True)
    assert found["y"].multiple is None and found["y"].flagged and found["y"].reason == "appeared: $1K→$9M since 2021"
    assert not found["z"].flagged and found["z"].reason == "within organic range"
    shares = spark.createDataFrame([("h", 1, 60.0), ("h", 2, 40.0), ("h", 3, 0.0)], "hs string, s int, usd double")
    r = trade.concentration(shares, ["hs"], "s", "usd", [2]).head()
    assert (r.hhi, r.top_share_pct, r.sensitive_share_pct, r.concentrated, r.risk) == (0.52, 60.0, 40.0, True, 0.633)


def test_entities(spark):
    people = [(1, "Ali Khamenei", "person", 5), (2, "ali khamenei", "person", 9), (3, "Khamenei", "person", 1), (4, "unnamed man", "person", 0), (5, "KHAMENEI", "person", 0), (6, "Moscow", "agency", 1)]
    drops, merges = entities.merge_plan(spark.createDataFrame(people, "id bigint, name string, kind string, claims bigint"), ["moscow"])
    assert {r.id for r in drops.collect()} == {4, 6}
    assert {(r.from_id, r.into_id) for r in merges.collect()} == {(1, 2), (3, 2), (5, 2)}


def test_signals(spark):
    people = ["Ivan Petrov", "Dr. Ivan Petrov", "Oleg Orlov", "Ilya Ivanov", "Pyotr Kim"]
    rows_ = [("ru", p, "person", "defendant", "on trial", i, "2026-07-10") for i, p in enumerate(people[:4])]
    rows_ += [("ru", people[4], "person", "target", "gave a speech", 8, "2026-07-10"), ("ru", people[4], "agency", "defendant", "x", 9, "2026-07-10"), ("ru", people[4], "person", "accused", "x", 7, "2026-01-01")]
    df = spark.createDataFrame(rows_, "theater string, person string, kind string, role string, says string, claim int, d string").withColumn("d", F.to_date("d"))
    found = signals.purges(df, "theater", "person", "kind", "role", "says", "claim", "d", F.lit("2026-07-15").cast("date"), 30)
    assert rows(found) == [("ru", 3, 4, "watch")]  # two spellings of one person, others not under pressure or too long ago
    flows = spark.createDataFrame([("a", "All goods", True), ("a", "8542", True), ("b", "8542", False)], "k string, hs string, flagged boolean")
    assert rows(signals.trade_signals(flows, "hs", "All goods").select("n", "severity")) == [(1, "watch")]
    assert signals.trade_signals(flows.where("hs = 'All goods'"), "hs", "All goods").count() == 0


def test_reports():
    html = "<html><head><title>x</title></head><body><h1>Assessment, June 30, 2026</h1><p>Forces advanced. A blogger claimed gains.[1] More.</p><script>no</script><ul><li>One</li><li>Two</li></ul></body></html>"
    parts = html_reports.page_parts(html)
    assert parts["title"] == "Assessment, June 30, 2026" and parts["items"] == ["One", "Two"] and "no" not in " ".join(parts["paragraphs"])
    assert html_reports.date_in_title(parts["title"]) == "2026-06-30"
    assert html_reports.marker_contexts(parts["paragraphs"][0]) == {1: "A blogger claimed gains."}
    assert html_reports.endnotes("[1] https://a.b/c; https://d.e [2] none [3] https://f.g).") == {1: ["https://a.b/c", "https://d.e"], 3: ["https://f.g"]}
    assert html_reports.page_parts(None)["title"] is None


def test_union_of_arms(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, score double")
    k = spark.createDataFrame([(2,), (3,)], "id int")
    assert rows(retrieval.union_arms(v, k, "id", "score")) == [(1, 0.9, False), (2, 0.5, True), (3, None, True)]


def test_watermarks():
    t = lambda d, h=0: datetime(2026, 7, d, h)
    assert incremental.poll_start(t(10, 12), t(10, 13)) == datetime(2026, 7, 10, 11, 30)
    assert incremental.poll_start(None, t(10)) == t(9) and incremental.poll_start(t(1), t(10)) == t(3)
    assert incremental.next_watermark(t(5), t(4), True, True) == t(5)
    assert incremental.next_watermark(t(5), t(6), True, False) == t(5) and incremental.next_watermark(t(5), t(6), True, True) == t(6)


def test_streams_take_rows_once(spark, tmp_path):
    def put(n, first):
        spark.range(first, first + n).select("id", F.lit("2026-07-01 00:00:00").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(10, 0)
    put(10, 5)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run = lambda: incremental.write_available(incremental.first_arrivals(incremental.file_stream(spark, f"{tmp_path}/in", schema), ["id"], "ts"), f"{tmp_path}/out", f"{tmp_path}/check")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15
    put(10, 10)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(20))


def test_endnotes_of_nested_blocks():
    html = """<h1>Report, May 3, 2024</h1><p>He claimed it.[1] It is confirmed.[2] So he said.[3]</p>
      <section class="x endnote-accordion-content y"><div><div>[1] <a href="#">https://a.example/1</a></div><div><p>[2] https://b.example ; https://c.example</p></div></div></section>
      <div><div class="endnote-accordion-content"><ul><li>[3] https://d.example</li></ul></div></div><p>After.[1]</p>"""
    found = html_reports.report(html)
    assert [(n, u) for n, u, _ in found["citations"]] == [(1, "https://a.example/1"), (2, "https://b.example"), (2, "https://c.example"), (3, "https://d.example")]
    assert [c for _, _, c in found["citations"]] == ["He claimed it.", "It is confirmed.", "It is confirmed.", "So he said."]
    assert html_reports.report("<p>x</p><p>[1] https://a.example</p>")["citations"][0][1] == "https://a.example"
    assert html_reports.report('<p>x</p><div class="endnote-accordion-content"></div><p>[1] https://a.example</p>')["citations"] == []


def _plans(monkeypatch, run):
    """Plans of the tables that an operator writes, and of what it returns."""
    plans, kept = [], near_duplicates.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(near_duplicates, "written", lambda df, what: plans.append((what, plan(df))) or kept(df, what))
    out = run()
    return [*plans, ("", plan(out))]


def test_first_seen_sends_no_table(spark, monkeypatch):
    """Tables that grow with the documents don't pass the driver, not even while they are small."""
    monkeypatch.setattr(near_duplicates, "IN_TASK", 0)
    df = spark.createDataFrame([(k, f"one two three four five six seven {k // 3}") for k in range(30)], "id bigint, t string")
    plans = _plans(monkeypatch, lambda: near_duplicates.first_seen_groups(df, "id", "t"))
    assert len(plans) > 5 and not [what for what, p in plans if "Broadcast" in p]


def test_shingle_sets_are_made_once(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"one two three four five six seven {k // 3}") for k in range(30)], "id bigint, t string")
    assert [what for what, p in _plans(monkeypatch, lambda: near_duplicates.shingle_pairs(df, "id", "t")) if "array_distinct" in p] == ["shingle-sets"]


def test_shingle_pairs_send_a_set_to_few_tasks(spark, monkeypatch):
    """Of 100 near copies there are 4,950 pairs; a set goes to each group of sets once."""
    rng, words = random.Random(6), [f"w{k}" for k in range(80)]
    texts = [[f"x{i}" if k == at else w for k, w in enumerate(words)] for i, at in ((i, rng.randrange(80)) for i in range(100))]
    docs = [(f"{i:03}", " ".join(t)) for i, t in enumerate(texts)] + [("c", " ".join(texts[0])), ("d", "one  two"), ("e", "one two"), ("f", "one two!"), ("n", None), ("o", None), ("p", "")]
    seen, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow: seen.append(self.count()) or f(self, *a))
    found = {(r.left, r.right): r.jaccard for r in near_duplicates.shingle_pairs(spark.createDataFrame(docs, "id string, t string").repartition(3), "id", "t").collect()}
    sets = {k: set(near_duplicates.runs_of(t.replace("!", "").split())) for k, t in docs if t and k not in ("c", "e")}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    assert found == {p: j for p, j in want.items() if j >= 0.7} and len(found) > 4000
    assert seen[0] < 1_500


def test_signatures_of_words(spark):
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 50, 3000]:
        words = ["".join(rng.choices("abé\U0001d4b3", k=rng.randint(1, 9))) for _ in range(n)]
        assert (near_duplicates.signature_of(words) == near_duplicates.signature(near_duplicates.runs_of(words))).all()


def test_signatures_of_several_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [["".join(rng.choices("abé\U0001d4b3", k=rng.choice([1, 5, 9, 90]))) for _ in range(n)] for n in (0, 1, 700, 2, 0, 3, 40, 900, 0)]
    want = [near_duplicates.signature(near_duplicates.runs_of(words)).tolist() for words in texts]
    for at_once in (8192, 7):
        monkeypatch.setattr(near_duplicates, "RUNS_AT_ONCE", at_once)
        assert near_duplicates.signatures_of(texts).tolist() == want
    assert near_duplicates.signatures_of([]).shape == (0, near_duplicates.HASHES)
    docs = [(k, None if not words and k else " ".join(words).replace("\U0001d4b3", "z")) for k, words in enumerate(texts)]
    found = near_duplicates.with_signatures(spark.createDataFrame(docs, "id int, t string").coalesce(1), "t").collect()
    assert all(r.signature == near_duplicates.signature_of((docs[r.id][1] or "").split()).tolist() for r in found)


def test_first_seen_candidates_that_cannot_join(spark, monkeypatch):
    """Texts that share bands only by a passage: most pairs of them can't join, and no document waits for them."""
    monkeypatch.setattr(near_duplicates, "IN_TASK", 0)
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    passage = words(40)
    docs = [(k, f"{passage} {words(60)}") for k in range(40)]
    df, kept = spark.createDataFrame(docs, "id bigint, t string"), []
    monkeypatch.setattr(near_duplicates, "written", lambda d, what, f=near_duplicates.written: kept.append((what, f(d, what))) or kept[-1][1])
    found = {r.id: r.canonical for r in near_duplicates.first_seen_groups(df, "id", "t").collect()}
    assert found == first_seen_one_by_one(docs)
    open_ = next(d for what, d in kept if what == "first-open")
    signed = {r.o: np.array(r.signature) for r in kept[0][1].collect()}
    band = near_duplicates.HASHES // near_duplicates.BANDS
    met = [(i, j) for i in signed for j in signed if j < i and (signed[i] == signed[j]).reshape(-1, band).all(1).any()]
    can_join = sum((signed[i] != signed[j]).sum() <= 2 * near_duplicates.most_differing(0.7) for i, j in met)
    assert len(met) > 20 and can_join <= open_.count() < len(met) / 2


def test_first_seen_near_copies_make_no_pairs(spark, monkeypatch):
    """Of 60 near copies with 1,770 pairs, nearly all are decided by the first one before pairs are made."""
    words, kept = [f"w{k}" for k in range(200)], []
    docs = [(i, " ".join(f"x{i}" if k == 3 * i else w for k, w in enumerate(words))) for i in range(60)]
    monkeypatch.setattr(near_duplicates, "written", lambda d, what, f=near_duplicates.written: kept.append((what, f(d, what))) or kept[-1][1])
    found = {r.id: r.canonical for r in near_duplicates.first_seen_groups(spark.createDataFrame(docs, "id bigint, t string"), "id", "t").collect()}
    assert found == first_seen_one_by_one(docs) and len(set(found.values())) < 5
    assert next(d for what, d in kept if what == "first-open").count() < 200


def test_html_is_parsed_by_few_pages(spark, monkeypatch):
    monkeypatch.setattr(html_reports, "PAGES", 3)
    monkeypatch.setattr(html_reports, "ship", lambda s: s)
    taken = []

    class Pages:
        sparkSession, dtypes = None, [("id", "bigint"), ("h", "string")]

        def select(self, *c):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)

    html_reports.parsed(Pages(), "id", "h")
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["<p>a</p>"] * 8)], ["id", "h"])
    assert [b.num_rows for b in taken[0](iter([batch]))] == [3, 3, 2]


def test_star_pairs_of_small_cells_meet_with_their_sets(spark):
    kind = "cell string, id bigint, t array<bigint>, e array<bigint>, h array<bigint>, d date, heavy array<bigint>"
    rows = spark.createDataFrame([("c", i, [i, 1], [2], [3], __import__("datetime").date(2024, 1, 1 + i), [1]) for i in range(5)], kind)
    plan = claims.claim_links(rows, 0.35, False)._jdf.queryExecution().executedPlan().toString().splitlines()
    pairs = next(i for i, line in enumerate(plan) if "Join" in line and "datediff" in line)
    assert not any("Join" in line for line in plan[:pairs])  # nothing is joined to pairs, so nothing of them is shuffled
