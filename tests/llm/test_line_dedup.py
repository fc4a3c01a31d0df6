"""Line dedup against a brute-force version."""

import random
import time

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.randrange(2)] = rng.choice(["", "a", "é", " "])
        out = out or ["a"]
    return "".join(out)


def brute(docs, most=2, each=20):
    first, out = {}, {}
    for key, text in docs:
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" "):
                first.setdefault(line, (key, i))

    def near(x, y):
        x, y = x.encode(), y.encode()
        edits = min(most, min(len(x), len(y)) // each)
        return edits and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits

    late = {y for y in first for x in first if first[x] < first[y] and near(x, y)}
    for key, text in docs:
        kept = [x for i, x in enumerate(text.split("\n")) if not x.strip(" ") or (x not in late and first[x] == (key, i))] if text is not None else None
        out[key] = kept if kept is None else "\n".join(kept)
    return out


def case(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(size)) for size in (17, 20, 21, 30, 40, 40, 41, 60)]
    line = lambda: rng.choice(["", " ", "x", "short line", "short lime"]) if rng.random() < 0.2 else changed(rng, rng.choice(base), rng.randint(0, 3))
    return [(i, "\n".join(line() for _ in range(10))) for i in range(20)] + [(77, None), (78, "")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = case(seed)
        df = spark.createDataFrame([(k, t, "kept", 5) for k, t in docs], "doc_id bigint, text string, source string, n_lines int")
        found = L.deduplicate(df)
        assert found.columns == ["doc_id", "text", "source", "n_lines", "n_exact", "n_near"]
        assert {r.doc_id: r.text for r in found.collect()} == brute(docs)


def test_bit_parallel_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(8, 50)))
        pairs.append((a, changed(rng, a, rng.randint(0, 4))))
    df = spark.createDataFrame([p for p in pairs if len(p[1].encode()) >= 7], "a string, b string")
    longer = F.octet_length("a") >= F.octet_length("b")
    x, y = F.encode(F.when(longer, F.col("a")).otherwise(F.col("b")), "UTF-8"), F.encode(F.when(longer, F.col("b")).otherwise(F.col("a")), "UTF-8")
    for k in (1, 2, 3):
        for r in df.select("a", "b", L.within(x, y, k).alias("near"), L.plausible(x, y, k).alias("may")).collect():
            near = distance(r.a.encode(), r.b.encode()) <= k
            assert r.near == near and (r.may or not near)


def test_probes_find_every_pair(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(12, 30)))
        b = changed(rng, a, 2)
        pairs.append((a, b) if len(a.encode()) <= len(b.encode()) else (b, a))
    df = spark.createDataFrame([p for p in pairs if len(p[0]) >= 9], "a string, b string")
    size = lambda c: F.octet_length(c).cast("int")
    met = F.size(F.array_intersect(L.index_keys(F.encode("a", "UTF-8"), size("a"), 2, 4), L.probe_keys(F.encode("b", "UTF-8"), size("b"), 2, 4))) > 0
    assert all(r.met for r in df.select("a", "b", met.alias("met")).collect() if distance(r.a.encode(), r.b.encode()) <= 2)


def test_nulls_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one\ntwo"), (1, "two\nthree"), (1, "two\nthree"), (1, "other\none"), (2, None)], "doc_id bigint, text string")
    rows = sorted(((r.doc_id, r.text) for r in L.deduplicate(df).collect()), key=str)
    assert rows == sorted([(None, "one\ntwo"), (1, "three"), (1, "three"), (1, "other"), (2, None)], key=str)
    assert L.deduplicate(df.limit(0)).count() == 0


def test_hot_keys_are_dealt_without_loss(spark, monkeypatch):
    docs = case(3)[:9]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(L, "HOT_LINES", 3)
    assert {r.doc_id: r.text for r in L.deduplicate(df).collect()} == brute(docs)


def test_a_segment_that_half_of_all_lines_share(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_LINES", 16)
    rng = random.Random(8)
    lines = ["the same first words of each line " + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(80)]
    lines += [changed(rng, x, 1) for x in lines[:10]] + ["".join(rng.choice("klmnopqr") for _ in range(60)) for _ in range(80)]
    docs = [(i, x) for i, x in enumerate(lines)]
    assert {r.doc_id: r.text for r in L.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == brute(docs)


def test_columns_keep_their_values(spark):
    names = ["n_lines", "hash", "doc", "of", "exact", "near", "__hash", "c0", "key", "first"]
    df = spark.createDataFrame([(1, "a line\na line", *(f"mine {n}" for n in names))], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    r = L.deduplicate(df).head()
    assert r.text == "a line" and (r.n_lines, r.n_exact, r.n_near) == (2, 1, 0)
    assert all(r[n] == f"mine {n}" for n in names if n != "n_lines")


def test_long_lines(spark):
    long = "word " * 2000
    docs = [(1, long), (2, long + "x"), (3, long.replace("word ", "ward ", 1)), (4, "y" + long[: len(long) // 2])]
    found = {r.doc_id: r.text for r in L.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == {1: long, 2: "", 3: "", 4: docs[3][1]}


def test_counts_of_characters(spark):
    texts = ["", "see the sea shells", "e" * 37, "ÀÉ e中\ttnraoi shldcumf", "x" * 300, "no on  no"]
    for r in L.counted(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        got = [r.counts >> 4 * i & 15 for i in range(len(L.COUNTED))]
        assert got == [r.text.count(c) % 16 for c in L.COUNTED]


def test_long_text_of_dropped_lines(spark):
    """A text is split once, not for each line that it loses."""
    lines = [f"{i} a line" for i in range(20000)]
    text = "\n".join(["own"] + lines + ["end"])
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, text)], "doc_id long, text string")
    started = time.time()
    found = {r.doc_id: r for r in L.deduplicate(rows).collect()}
    assert time.time() - started < 60
    assert found[1].text == "\n".join(lines) and found[2].text == "own\nend"
    assert (found[2].n_lines, found[2].n_exact, found[2].n_near) == (20002, 20000, 0)
