"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def typed(i, text, errors):
    for m in RUN.finditer(text or ""):
        w = re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
        h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
        yield w[: h % len(w)] + w[h % len(w) + 1 :] if errors and h % errors == 0 else w


def brute(rows, errors=S.ERRORS):
    counts = Counter(w for i, t in rows for w in typed(i, t, errors) if len(w) >= 6)
    counts = {w: n for w, n in counts.items() if n >= 5}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            gaps[w[:k] + "\0" + w[k + 1 :]].add(w)  # a code point replaced
            if (shorter := w[:k] + w[k + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in gaps.values():
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, S.variants(df, **more).collect()))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_few_letters(spark, block):
    """Many words that are near each other, of lengths from six on, in blocks that are subdivided to the end."""
    rng = random.Random(block)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 6, 7, 7, 8, 9, 12]))) for _ in range(400)]
    rows = [(i, " ".join(w for w in rng.sample(base, 120) for _ in range(rng.choice([1, 1, 2, 9])))) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string").repartition(4)
    want = brute(rows)
    assert found(df, block=block) == want and sum(w[2] for w in want) > 600


def test_one_edit_of_each_kind(spark):
    words = "abcdefg abcdfg xabcdefg abcdefgx abXdefg abcdXfg bacdefg zzzzzz zzzzzzz aaaaaaaa aaaaaaa aaaaaabaa".split()
    rows = [(i, " ".join(words)) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, errors=None) == brute(rows, None)
    near = {r[0]: r[2] for r in found(df, errors=None, block=1)}
    assert near["abcdefg"] == 5 and near["bacdefg"] == 0 and near["zzzzzz"] == 1


def test_odd_texts(spark):
    long = "".join(random.Random(5).choice("abc") for _ in range(20_000))
    rows = [(None, None), (1, ""), (None, "nullid nullid " * 3), (2, "12 ab ×÷ÀÉÿab Ābcdefgh"), (3, "NATION nation Nation ÉLEVER Élever " * 40)]
    rows += [(9, f"{long} {long}x")] * 6 + [(4, "nations natiom nation " * 5)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == brute(rows)
    assert S.variants(df.limit(0)).count() == 0


def test_a_chain_of_forms(spark):
    """abcdef is rarer than abcdefg, that than abcdefgh: the root is the last."""
    rows = [(1, "wordaa " * 5 + "wordaab " * 30 + "wordaabc " * 200 + "wordaabcd " * 1100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: r[5] for r in found(df, errors=None)}
    assert set(got.values()) == {"wordaabcd"} and found(df, errors=None) == brute(rows, None)


def test_query(spark, sf):
    from tessera.llm.queries import op13_spelling

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op13_spelling(spark, sf)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, df.collect())) == brute(rows)
