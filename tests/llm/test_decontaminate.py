"""Benchmark decontamination against a brute-force search."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    spans: dict[tuple, set[int]] = {}
    for n, (_, t) in enumerate(items):
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            spans.setdefault(tuple(w[a : a + k]), set()).add(n)
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(s) for s in spans}:
            for a in range(len(w) - k + 1):
                if own := spans.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= own
        out.append((len(w), len(hit), sorted("null" if items[n][0] is None else str(items[n][0]) for n in found)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "x1", "zz-top"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 14, 25]))) for i in range(10)] + [(99, None), (None, text(12)), (3, text(12))]
    docs = [text(rng.choice([0, 5, 60, 300])) + rng.choice(["", " other words"]) for _ in range(60)] + [None, "", "-- !!"] + [t for _, t in items]
    return docs, items


def test_scan_against_brute_force():
    for seed in range(4):
        docs, items = case(seed)
        b = D.Benchmark(items)
        assert [(n, sum(z - a for a, z in s), sorted(b.names[o] for o in own)) for n, s, own in D.scan(docs, b)] == brute(docs, items)


def test_longest_matches_against_brute_force():
    docs, items = case(7)
    items = [(i, t) for i, t in items if len(words(t)) >= 10]
    b = D.Benchmark(items)
    ids = [i for d in docs for i in [*(b.vocabulary.get(w, -1) for w in D.words(d)), -1]]
    sizes, places = D.Shard(np.array(ids, np.int32), b.depth, b.shortest).longest(b)
    ends = np.nonzero(b.words < 0)[0]
    for k, at in enumerate(b.suffixes):
        q = b.words[at : ends[np.searchsorted(ends, at)]].tolist()
        best = 0
        for p in range(len(ids)):
            n = 0
            while n < len(q) and p + n < len(ids) and ids[p + n] == q[n]:
                n += 1
            best = max(best, n)
        assert (sizes[k] if sizes[k] >= b.shortest else 0) == (best if best >= b.shortest else 0)
        if sizes[k] >= b.shortest:
            assert ids[places[k] : places[k] + sizes[k]] == q[: sizes[k]]


def test_operator_in_one_and_more_blocks(spark, monkeypatch):
    docs, items = case(2)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for size in (D.BLOCK_BYTES, 200):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        rows = sorted(D.overlaps(df, bench).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_hit, sorted(r["items"])) for r in rows] == want
        assert [sum(s.end - s.first for s in r.spans) for r in rows] == [n for _, n, _ in want]
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in enumerate(want) if not w[1]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")
    assert D.overlaps(docs, none).head().n_hit == 0
    assert D.decontaminate(docs, none).count() == 1
    assert D.overlaps(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_longest_matches_of_a_table(spark, monkeypatch):
    docs, items = case(3)
    items = [(i, t) for i, t in items if i is not None and t][:6]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    shortest = min(min(10, len(words(t))) for _, t in items)
    for size in (D.BLOCK_BYTES, 200):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        found = {(r.item, r.first): r for r in D.longest_matches(df, bench).collect()}
        texts = [words(t) for t in docs]
        if size > 200:  # the shortest window is a block's own
            for name, t in items:
                w = words(t)
                for a in range(len(w)):
                    best = 0
                    for d in texts:
                        for p in range(len(d)):
                            n = 0
                            while a + n < len(w) and p + n < len(d) and d[p + n] == w[a + n]:
                                n += 1
                            best = max(best, n)
                    assert (found[str(name), a].size if (str(name), a) in found else 0) == (best if best >= shortest else 0)
        for (name, a), r in found.items():
            w = words(dict((str(i), t) for i, t in items)[name])
            assert texts[int(r.doc)][r.word : r.word + r.size] == w[a : a + r.size]


def test_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    docs, items = case(5)
    docs = [" ".join(t or "" for t in docs) * 20, *docs, docs[3], docs[3]]
    b = D.Benchmark(items)
    assert [(n, sum(z - a for a, z in s), sorted(b.names[o] for o in own)) for n, s, own in D.scan(docs, b)] == brute(docs, items)
