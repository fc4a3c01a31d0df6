"""PPM scores and the baseline against brute-force versions."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common
from tessera.llm import language_model as M


def texts(seed, n=60):
    rng = random.Random(seed)
    syllables = ["ta", "re", "on", "é", "Ing", "st", "x1"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(n)]


def contexts(train):
    """Counts after each context: whole ones of ORDER bytes, else in how many longer ones a byte was seen."""
    level = {M.ORDER: defaultdict(Counter)}
    for t in train:
        raw = M.START + b" ".join(M.tokens(t)[:-1]) + b"\n"
        for i in range(M.ORDER, len(raw)):
            level[M.ORDER][raw[i - M.ORDER : i]][raw[i]] += 1
    for k in range(M.ORDER - 1, -1, -1):
        level[k] = defaultdict(Counter)
        for c, seen in level[k + 1].items():
            for x in seen:
                level[k][c[1:]][x] += 1
    return level


def brute(level, text):
    raw, total = M.START + b" ".join(M.tokens(text)[:-1]) + b"\n", 0.0
    for i in range(M.ORDER, len(raw)):
        excluded: set[int] = set()
        for k in range(M.ORDER, -1, -1):
            seen = level[k].get(raw[i - k : i] if k else b"")
            left = {x: n for x, n in (seen or {}).items() if x not in excluded}
            if left:
                size = sum(left.values()) + len(left)
                if raw[i] in left:
                    total += math.log10(left[raw[i]] / size)
                    break
                total += math.log10(len(left) / size)
            excluded |= set(seen or ())
        else:
            total -= math.log10(256 - len(excluded))
    return total


def gram(raw):
    return int.from_bytes(raw[-M.ORDER - 1 :], "big")


def test_code_lengths_of_a_context_sum_to_one(spark):
    train = spark.createDataFrame([(t,) for t in texts(3)], "text string")
    counts = M.known_lengths(M.gram_counts(train)).cache()
    nodes = M.trie(counts.select("key", "n"))
    before = [(M.START + b)[-M.ORDER :] for b in (b"", b"ta", b"re on ta", b"zz", "é x".encode())]
    asked = spark.createDataFrame([(gram(b + bytes([x])),) for b in before for x in range(256)], "key bigint")
    others = M.unknown_lengths(asked.join(counts, "key", "left_anti"), nodes, *M.contexts(nodes))
    value = {r.key: r.value for r in asked.join(counts, "key").select("key", "value").unionByName(others).collect()}
    for b in before:
        assert abs(sum(10 ** value[gram(b + bytes([x]))] for x in range(256)) - 1) < 1e-9


def test_long_texts_are_cut_in_pieces_without_change(monkeypatch):
    some = [M.tokens(t) for t in [*texts(7, 20), "a " * 3000, "", None]]
    whole = M.grams(some)
    monkeypatch.setattr(M, "BYTES_AT_ONCE", 64)
    assert all((a == b).all() for a, b in zip(whole, M.grams(some)))
    owners = np.concatenate([o for _, o in M.codes(some)])
    assert np.bincount(owners, minlength=len(some)).tolist() == [len(b" ".join(t[:-1])) + 1 for t in some]


@pytest.mark.parametrize("sent", [0, 20, 10_000])
def test_nothing_hangs_on_what_is_sent(spark, monkeypatch, sent):
    """The model is whole however little of it goes to the executors, also where all grams are seen once."""
    monkeypatch.setattr(M, "SENT", sent)
    rows = [*enumerate(texts(11)), (99, "ZZ \x01 漢字 ta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    level = contexts([t for d, t in rows if d % 2])
    assert all(math.isclose(r.score, brute(level, r.text), rel_tol=1e-9) for r in M.score(df, df.where("doc_id % 2 = 1")).collect())


def test_the_most_frequent_fill_the_bound_where_counts_tie(spark):
    df = spark.createDataFrame([(k, 5 if k < 100 else 1) for k in range(20_000)], "key bigint, n bigint")
    kept = df.where(M._most(df, 10_000))
    assert 9_000 < kept.count() <= 10_000 and kept.where("n = 5").count() == 100


def test_scores_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 5)
    monkeypatch.setattr(M, "SENT", 100)
    rows = [*enumerate(texts(5)), (100, None), (101, ""), (None, "ta re"), (101, ""), (102, "unseen Words")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, score string")
    train = df.where("doc_id % 3 <> 0")
    counts = Counter(w for d, t in rows if d is not None and d % 3 for w in M.tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    level = contexts([t for d, t in rows if d is not None and d % 3])
    found = M.score(df, train).collect()
    assert sorted(found[0].asDict()) == sorted(["doc_id", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    key = lambda r: (str(r[0]), str(r[1]))
    for r, (d, t) in zip(sorted(found, key=key), sorted(rows, key=key)):
        own = M.tokens(t)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (d, len(own), sum(w in counts for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, brute(level, t), rel_tol=1e-9)


def test_no_training_and_no_rows(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    r = M.score(df, df.limit(0)).head()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and math.isclose(r.score, -3 * math.log10(256))
    assert M.score(df.limit(0), df).count() == 0


class Taken:
    """Stands for a table and keeps what its workers would run."""

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


@pytest.mark.parametrize("count", [M.word_counts, M.gram_counts])
def test_a_worker_holds_little_of_what_its_task_reads(spark, monkeypatch, count):
    """400,000 different words in one batch, after a task that had a model."""
    for bound in ("GRAMS_AT_ONCE", "WORDS_AT_ONCE"):
        monkeypatch.setattr(M, bound, 1 << 14, raising=False)
    monkeypatch.setitem(M._KEPT, "earlier", None)
    some = [" ".join(f"{k:07x}" for k in range(a, a + 200)) for a in range(0, 400_000, 200)]
    batch = pa.RecordBatch.from_pydict({"text": [*some, None, ""]})
    count(taken := Taken())
    tracemalloc.start()
    try:
        n = sum(sum(b.column(1).to_pylist()) for b in taken.run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == (400_000 + 2002 if count is M.word_counts else 400_000 * 8 + 2)
    assert most < 24e6 and not M._KEPT


def test_texts_are_cut_by_size_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(M, "BYTES_AT_ONCE", 10)
    column = pa.array(["", None, "x" * 25, "ab", "é" * 4, "c", None])
    assert list(M.cuts(column)) == [(0, 3), (3, 5), (5, 7)] and list(M.cuts(column[:0])) == []
    assert list(M.cuts(column[3:])) == [(0, 2), (2, 4)]


@pytest.mark.parametrize("bound", [("WORDS_AT_ONCE", 3), ("TEXT_AT_ONCE", 100)])
def test_counts_passed_on_early_are_added_up(spark, monkeypatch, bound):
    monkeypatch.setattr(M, "GRAMS_AT_ONCE", 40)
    monkeypatch.setattr(M, *bound)
    monkeypatch.setattr(M, "BYTES_AT_ONCE", 64)
    some = texts(13)
    column = pa.RecordBatch.from_pydict({"text": some})
    for count, whole in ((M.word_counts, Counter(w for t in some for w in M.tokens(t))), (M.gram_counts, dict(zip(*(x.tolist() for x in M.grams([M.tokens(t) for t in some])))))):
        count(taken := Taken())
        found = Counter()
        for b in taken.run(iter([column, column[:0], column])):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[k] += n
        assert found == {k: 2 * n for k, n in whole.items()}


def test_a_table_of_many_keys_has_them_all(monkeypatch):
    monkeypatch.setattr(M, "KEYS_AT_ONCE", 100)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5_000))
    kept = M.Hashed(keys, keys * 0.5)
    assert (kept.get(keys) == keys * 0.5).all() and np.isnan(kept.get(keys + 1)[~np.isin(keys + 1, keys)]).all()


def test_the_session_keeps_its_number_of_rows(spark):
    before = spark.conf.get(common.BATCH_KEY)
    with common.smaller_batches(spark):
        assert spark.conf.get(common.BATCH_KEY) in (str(common.BATCH_ROWS), before)
    assert spark.conf.get(common.BATCH_KEY) == before
