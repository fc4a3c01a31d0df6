"""The kept word index against whole scans, and that late blocks' places aren't read."""

import math
import random
import re
from datetime import date

import pyarrow as pa
import pytest

from tessera.functions.stemming import stem
from tessera.operators import text_search as T

WORDS = "run running runs runner tank tanks ship shipping the of port ports porting e-mail mid-sea mail sea missile missiles naïve".split()


def brute(docs, question, terms=(), limit=10, names=(), first=None, last=None):
    groups = T.parsed(question)
    lexemes = T._needed(groups)
    by_distance = len(groups) == 1 and len(lexemes) > 1
    found = []
    for i, text, day in docs:
        low = (text or "").lower()
        at = {x: [] for x in lexemes}
        for p, w in enumerate(re.findall(r"[^\W_]+", low), 1):
            if (x := T.lexeme(w)) in at:
                at[x].append(p)
        holds = lambda item: any(all(p + o in at[x] for x, o in zip(item.lexemes, item.offsets)) for p in at[item.lexemes[0]])  # noqa: E731, B023
        hit = any(all(holds(item) != item.excluded for item in g) for g in groups)
        hit = hit or any(t in low for t in terms) or any(n == i and any(t in x.lower() for t in terms) for n, x in names)
        if not hit or (first and (day is None or day < first)) or (last and (day is None or day > last)):
            continue
        if by_distance:
            left, own = 1.0, list(at.values())
            for a in range(1, len(own)):
                for b in range(a):
                    for x in own[a]:
                        for y in own[b]:
                            d = abs(x - y)
                            left *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
            rank = 1 - left
        else:
            rank = sum(0.1 * sum(1 / j**2 for j in range(1, len(p) + 1)) for p in at.values()) / 1.64493406685 / max(1, len(at))
        found.append((i, day, round(rank, 7)))
    found.sort(key=lambda r: (-r[2], -(r[1] or date.min).toordinal(), -r[0]))
    return [(*r, len(found)) for r in found[:limit]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    docs = []
    for i in range(700):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 8, 30])))
        docs.append((i, rng.choice([text, text.upper(), text + "."]), rng.choice([None, date(2024, 1, 1 + i % 28)])))
    docs += [(700, None, None), (701, "", date(2024, 1, 2)), (702, "tank " * 3000 + "ship", date(2024, 1, 3))]
    df = spark.createDataFrame(docs, "doc bigint, text string, day date").repartition(5)
    store = f"file://{tmp_path_factory.mktemp('texts')}/a"
    T.build(df, store, "doc", "text", "day")
    return store, docs


def same(found, want):
    got = [(r.id, r.day, r["rank"], r.match_count) for r in found.collect()]
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(abs(g[2] - w[2]) < 3e-7 for g, w in zip(got, want))


QUESTIONS = ["running tank", "tank", "tank or missile", '"run tank"', '"port of ship" -sea', "-tank", "the of", "", 'e-mail or "mid sea"', "ships ports missile", "naïve runner -run", "tank -tank", '"the tank"']


@pytest.mark.parametrize("question", QUESTIONS)
def test_questions(spark, index, question):
    store, docs = index
    for limit in (5,) if len(question) % 2 else (1000,):
        same(T.search(spark, store, question, limit=limit), brute(docs, question, limit=limit))


def test_terms_names_and_windows(spark, index):
    store, docs = index
    named = next(i for i, t, _ in docs if "tank" in (t or "").lower().split() and "ship" not in t.lower())
    names = [(3, "Tank Corps"), (3, "tank corps"), (named, "The Ship"), (700, "Black Sea"), (5, "x"), (None, "tank")]
    df = spark.createDataFrame([(i, n, docs[i][2] if i is not None else None) for i, n in names], "id bigint, name string, day date")
    for question, terms in (("missile", ["ail", "e-m"]), ("", ["ank"]), ("running port", ["d-s"]), ("runner", ["nothing"]), ("ship", ["TANK"]), ("tank runner", ["corps", "ship"])):
        low = [t.lower() for t in terms]
        same(T.search(spark, store, question, terms, 20, df), brute(docs, question, low, 20, names))
        same(T.search(spark, store, question, terms, 20, df, "2024-01-05", "2024-01-20"), brute(docs, question, low, 20, names, date(2024, 1, 5), date(2024, 1, 20)))


def test_blocks_of_low_maxima_are_left_out(spark, index, monkeypatch):
    store, docs = index
    monkeypatch.setattr(T, "BLOCK_DOCS", 4)
    df = spark.createDataFrame(docs, "doc bigint, text string, day date")
    T.build(df, other := store + "-small", "doc", "text", "day")
    seen = []
    plain = T.rank_of
    monkeypatch.setattr(T, "rank_of", lambda *a: seen.append(1) or plain(*a))
    same(T.search(spark, other, "tank", limit=3), brute(docs, "tank", limit=3))
    assert len(seen) == 2  # the blocks of the highest maxima, then those that may hold as much


def test_empty(spark, tmp_path):
    T.build(spark.createDataFrame([], "doc bigint, text string"), store := f"file://{tmp_path}/e", "doc", "text")
    assert T.search(spark, store, "tank or -ship", ["a"]).count() == 0


def test_stems():
    known = "consignment consign consistency consist conspicuous conspicu knackeries knackeri dying die skies sky happily happili hopping hop hoped hope luxuriated luxuri relational relat generously generous"
    words = known.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_postings_gather_a_block_before_words_are_shuffled(monkeypatch):
    """A word in a block is one row from the first, and more only where the block has very many words."""
    texts = [(1, 5, 0, "a-b a"), (2, None, 0, "a c"), (3, 7, 1, ""), (4, 7, 1, "c")]
    columns = [pa.array(x, t) for x, t in zip(zip(*texts), (pa.int64(), pa.int32(), pa.int64(), pa.string()))]
    batch = pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.date32()), *columns[2:]], ["id", "day", "block", "text"])
    rows = lambda: [r for b in T._postings(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    found = {(r["word"], r["block"]): (r["ids"], [d and (d - date(1970, 1, 1)).days for d in r["days"]], r["places"], r["most"]) for r in rows()}
    assert len(rows()) == len(found) == 7
    assert found["a", 0] == ([1, 2], [5, None], [[1, 3], [1]], 2) and found["c", 1] == ([4], [7], [[1]], 1)
    assert found["", 1] == ([3, 4], [7, 7], [[], []], 0) and found["a-b", 0] == ([1], [5], [[]], 0)
    monkeypatch.setattr(T, "PLACES", 1)
    assert len([r for r in rows() if r["word"] == "a"]) == 2
