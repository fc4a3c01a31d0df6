"""SimHash groups against brute force."""

import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from tessera.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def prints(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(20):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["Aa", "b", "é", "　x", "d,"], k=rng.randint(0, 40))) for _ in range(100)] + [None, "", " \x0b", "one", "Two words"]
    assert S.fingerprints(texts).tolist() == [fingerprint(t) for t in texts]


def test_bit_sliced_comparison():
    p = prints(2)
    for radius in (0, 1, 2, 3, 7):
        want = {(i, j) for i in range(50) for j in range(len(p)) if bin(int(p[i]) ^ int(p[j])).count("1") <= radius}
        assert set(zip(*(x.tolist() for x in S.Planes(p).within(p[:50], radius)))) == want
    left, right = p[:-1], p[1:]
    for radius in (2, 17):
        assert S.pairs_within(left, right, radius).tolist() == [bin(int(a) ^ int(b)).count("1") <= radius for a, b in zip(left, right)]


def test_links_connect_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 8)
    p = prints(3)
    at = {int(x): i for i, x in enumerate(p)}
    near = [(i, j) for i in range(len(p)) for j in range(i) if bin(int(p[i]) ^ int(p[j])).count("1") <= 2]
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print bigint")
    edges = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in S.links(df).collect()]
    assert roots(len(p), edges) == roots(len(p), near)
    assert {tuple(sorted(e, reverse=True)) for e in edges} <= set(near)


def test_groups(spark):
    rows = [(4, "a b c d e"), (2, "A b c d E"), (9, "other words are here now"), (5, None), (3, ""), (None, "a b c d e"), (9, "other words are here now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in S.groups(df).collect()), key=str)
    want = {4: 2, 2: 2, 9: 9, 5: 3, 3: 3, None: 2}
    assert got == sorted(((d, fingerprint(t), want[d]) for d, t in rows), key=str)
    assert S.groups(df.limit(0)).count() == 0


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(12):
        base = text(150)
        for _ in range(6):
            words = list(base)
            words[rng.randrange(150)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    for _ in range(40):
        group[len(rows)] = ("alone", len(rows))
        rows.append((len(rows), " ".join(text(120))))
    rows += [(500, None), (501, " ")]
    group[500] = group[501] = "none"
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, print string")
    least = {}
    for d, _ in rows:
        least.setdefault(group[d], d)
    for small, chunk in ((S.SMALL, S.CHUNK), (2, 2)):
        monkeypatch.setattr(S, "SMALL", small)
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert {r.doc_id: r.component_id for r in S.near_groups(df).collect()} == {d: least[group[d]] for d, _ in rows}
    kept = S.deduplicate(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(least.values())
    assert S.deduplicate(df.limit(0)).count() == 0


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_by_jaccard(rows, similarity=0.8):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]
    return {rows[i][0]: rows[r][0] for i, r in enumerate(roots(len(rows), pairs))}


def test_variants_with_many_copies_are_one_group(spark, monkeypatch):
    # two variants of a page at about 0.82, each with many closer copies: the copies' nearest ones are all of their own variant
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = list(base)
    for k in range(8):
        other[50 * k + 7] = "variant"
    rows = []
    for words in (base, other):
        for c in range(90):
            rows.append((len(rows), " ".join(words + [f"end{len(rows)}"])))
    want = components_by_jaccard(rows)
    assert set(want.values()) == {0}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk in (S.CLUSTER, 16):
        monkeypatch.setattr(S, "CLUSTER", chunk)
        assert {r.doc_id: r.component_id for r in S.near_groups(df).collect()} == want


def test_links_are_at_the_similarity_asked_for(spark):
    # pairs around 0.8 on both sides, short texts, and texts whose shingles repeat
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    add = lambda words: rows.append((len(rows), " ".join(words)))
    for n, step in ((200, 4), (200, 5), (200, 6), (200, 8), (9, 1), (8, 1)):
        for _ in range(40):
            words = text(n)
            add(words)
            add(words + text(1) if n < 10 else words[: n - step * 4] + text(step * 4 - 4))
    for _ in range(40):
        once, tail = text(30), text(40)
        add(once + tail)
        add(once * 6 + tail)
        add(once + tail * 6)
    want = components_by_jaccard(rows)
    assert 0.2 < sum(a != b for a, b in want.items()) / len(rows) < 0.8
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in S.near_groups(df).collect()} == want


def test_few_pairs_at_the_border_are_missed():
    rng = random.Random(7)
    missed = wide = 0
    for k in range(2000):
        n = (5, 45, 225)[k % 3]  # n - n / 10 of n shingles shared, or 4 of 5: about 0.8
        words = [f"{k} {j} {rng.random()}".replace(" ", "_") for j in range(n + 4)]
        other = words[: n + 3] if n == 5 else words[: n + 4 - n // 9] + [f"x{rng.random()}" for _ in range(n // 9)]
        prints, keys, _ = S.sketches([" ".join(words), " ".join(other)])
        missed += not (keys[0] == keys[1]).any()
        wide += (int(prints[0]) ^ int(prints[1])).bit_count() > S.WIDE
    assert missed <= 3 and wide <= 1
