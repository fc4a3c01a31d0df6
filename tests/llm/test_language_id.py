"""Language ID: held-out accuracy, undetermined texts, small training sets."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm.queries import op9_language_id


def test_held_out_accuracy(spark, sf):
    found = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_predictions_take_nothing_but_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    a = L.identify(docs, train)
    b = L.identify(docs.withColumn("lang", F.when(train, F.col("lang"))), train)
    pick = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in df.collect()}
    assert pick(a) == pick(b)


def test_undetermined(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "123 -- !", "de"), (None, "the dog", None), (5, "the the", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    found = L.identify(df)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r.doc_id, r.text): r.lang_pred for r in found.collect() if r.lang_pred == "und"} == {(3, None): "und", (4, ""): "und", (5, "123 -- !"): "und"}
    assert L.filtered(df).columns == df.columns and L.filtered(df).count() == 4
    assert {r.lang_pred for r in L.identify(df.where("doc_id = 1")).collect()} == {"en"}
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(df.limit(0)).count() == 0


def test_filter_rejects_gibberish_and_needs_no_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("text rlike '[A-Za-z]'")
    rng = random.Random(3)
    noise = [(-k, " ".join("".join(rng.choices("qxzjkvwbpfgh", k=7)) for _ in range(120)), None) for k in range(1, 21)]
    mixed = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in L.filtered(mixed).select("doc_id").collect()}
    assert not any(d in kept for d, _, _ in noise)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sum(d in kept for d in ids) >= 0.999 * len(ids)
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.filtered(blank).count() == docs.count()


def test_every_label_is_learned(spark):
    rows = [(20 * k + j, " ".join(f"{chr(97 + k)}{chr(97 + (k * 7 + i) % 26)}{chr(97 + k)}" for i in range(30)), f"l{k:02}") for k in range(20) for j in range(3)]
    found = L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert found.where("lang <> lang_pred").count() == 0


def test_whole_texts_of_a_sample_are_learned():
    """What is in one place of a long text only is in one of its vectors."""
    text = "plain words " * 2000 + "qqq" * 40 + " plain words" * 2000
    found = L.vectors(text)
    whole, size = L.trigrams(["qqq"])
    assert len(found) == L.PIECES and sum(n[whole[1]] for _, n in found) >= 38
    assert abs(sum(size for size, _ in found) - len(text)) < 10 + 4 * len(text) / L.PIECE
    assert L.vectors(None) == L.vectors("") == L.vectors("12 34") == []


def test_the_sample_is_bounded_also_where_one_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_LANGUAGE", 30)
    rows = [(7, f"the text of number {k}", "en") for k in range(2000)] + [(k, f"der Text hat die Nummer {k}", "de") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    langs, size, x = L.sample(df, F.lit(True))
    assert Counter(langs) == {"en": 30, "de": 30} and len(size) == len(x) == 60
    assert np.allclose(x.sum(1), 1, atol=1e-5)


def test_predictions_against_a_direct_reading_of_the_model():
    rng = random.Random(5)
    sounds = {"en": ["the", "and", "ing"], "de": ["der", "und", "ung"], "nl": ["het", "een", "ijk"], "fr": ["les", "eau", "ant"], "es": ["los", "que", "ado"]}
    text = lambda lang, n: " ".join(rng.choice(sounds[lang]) + rng.choice("aeiou") for _ in range(n))
    model = L.fit([(lang, text(lang, 60)) for lang in sounds for _ in range(30)])
    some = [text(lang, n) for lang in sounds for n in (1, 5, 300)] + ["", None, "12 -", "zzz", "the der los " * 3000]
    langs, scores = model.predict(some)
    sig = lambda v: 1 / (1 + math.exp(-max(-40, min(40, 2 * v))))
    for t, lang, score in zip(some, langs, scores):
        if not t or not L.LETTER.search(t):
            assert (lang, score) == ("und", 0.0)
            continue
        h, _ = L.trigrams([t])
        h = h[: L.trigrams([t])[1][0]]
        value = lambda m: float(np.mean(m[0][h].astype(np.float64))) + m[1]
        margins = [value(m) for m in model.family_models]
        best = int(np.argmax(margins))
        own, pair = model.families[best], {p: value(m) for p, m in model.pair_models.items()}
        of = lambda a, b: pair[a, b] if (a, b) in pair else -pair[b, a]
        won = {a: (sum(of(a, b) > 0 for b in own if b != a), sum(of(a, b) for b in own if b != a)) for a in own}
        assert won[lang][0] == max(w for w, _ in won.values())
        sure = sig(sorted(margins)[-1] - sorted(margins)[-2])
        assert abs(score - sure * min((sig(of(lang, b)) for b in own if b != lang), default=1.0)) < 1e-4
    assert sum(a == b for a, b in zip(langs, [lang for lang in sounds for _ in range(3)])) >= 13


def test_ties_of_won_pairs_go_to_the_first_name():
    none = (np.zeros(1 << L.BITS, np.float32), 0.0)
    model = L.Model([["c", "a", "b"]], [], {("c", "a"): none, ("c", "b"): none, ("a", "b"): none})
    assert model.predict(["some text"])[0] == ["a"]


def test_a_text_is_read_alike_whatever_comes_after_it():
    h, size = L.trigrams(["one text", "zz", "another"])
    assert (h[: size[0]] == L.trigrams(["one text", "another"])[0][: size[0]]).all() and (h[: size[0]] == L.trigrams(["one text"])[0][: size[0]]).all()
