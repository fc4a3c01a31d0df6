"""The registered queries against brute-force versions of their contracts, and columns whose names clash with operators' own."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, common, decontaminate, language_id, language_model, license_scan, queries, simhash
from tessera.llm.components import components

from .test_decontaminate import brute as overlaps
from .test_language_model import brute as code_length
from .test_language_model import contexts

SPACES = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r.doc_id: r for r in queries.op1_decontaminate(spark, sf).collect()}
    for d, (n, hit, own) in zip(docs, overlaps(docs.values(), items), strict=True):
        r = found[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(own), sha(",".join(own)), hit > 0)


def test_op2(spark, sf, docs):
    library = Tokenizer.from_file(queries.vocabulary())
    found = {r.doc_id: r for r in queries.op2_bpe(spark, sf).collect()}
    for d, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (found[d].n_tokens, found[d].ids_sha256, found[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op5(spark, sf, docs):
    prints = {}
    for d, t in docs.items():
        w = SPACES.findall(lower(t))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {d: d for d in prints}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids, values = np.array(list(prints)), np.array(list(prints.values()), np.uint64)
    for d in prints:
        for o in ids[np.bitwise_count(values ^ np.uint64(prints[d])) <= 2].tolist():
            a, b = root(d), root(o)
            group[max(a, b)] = min(a, b)
    found = queries.op5_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{prints[d]:016x}", root(d)) for d in docs}


def test_op7(spark, sf, docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*SPACES.findall(lower(t)), "\n"] for d, t in docs.items()}
    counts = Counter(w for d in docs if not held[d] for w in tokens[d])
    total, kinds = sum(counts.values()), len(counts)
    level = contexts([t for d, t in docs.items() if not held[d]])
    found = {r.doc_id: r for r in queries.op7_language_model(spark, sf).collect()}
    for d, own in tokens.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(w in counts for w in own), total)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)) < 1e-6 * len(own)
        if d % 5 == 0:
            assert abs(r.score - code_length(level, docs[d])) < 1e-6 * len(own)


OPERATORS = {
    "overlaps": (lambda df, _: decontaminate.overlaps(df, df.selectExpr("doc_id AS item_id", "text").limit(1)), {"n_words", "n_hit", "spans", "items"}),
    "encode": (lambda df, _: bpe.encode(df, queries.vocabulary()), {"ids", "n_tokens"}),
    "fingerprinted": (lambda df, _: simhash.fingerprinted(df), {"print"}),
    "licenses": (lambda df, _: license_scan.scan(df), {"licenses"}),
    "score": (lambda df, _: language_model.score(df, df), {"n_tokens", "n_known", "train_tokens", "base_score", "score"}),
    "identify": (lambda df, _: language_id.identify(df), {"lang_pred", "score"}),
    **{name: (lambda df, sf, stage=stage: stage(df.sparkSession, df, sf), set()) for name, stage in corpus_pipeline.STAGES[:-1]},
}
CLASHING = "__tessera __text __kept __hash __doc __exact __near n_words n_hit spans items n_lines n_exact n_near ids n_tokens print licenses score base_score lang_pred row rare grams made doc_hash c0 c1 component_id node of hash key value __least least".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_keep_their_values(spark, sf, name):
    run, new = OPERATORS[name]
    rows = [(1, "some plain words of a text that is long enough to be kept whole", "en", 60), (2, "andere Worte stehen hier in einer ganz anderen Zeile", "de", 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    df = df.select("*", *[F.concat(F.lit(f"mine {c} "), "doc_id").alias(c) for c in CLASHING])
    found = run(df, sf).collect()
    assert len(found) == 2
    for r in found:
        assert all(r[c] == f"mine {c} {r.doc_id}" for c in CLASHING if c not in new)


def test_hot_keys_meet_their_facts_where_they_are(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS key", "id")
    facts = rows.groupBy("key").count().selectExpr("key", "count", "key * 2 AS twice")
    a = common.spread_join(rows, facts, "key", "count", 100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, rows.join(facts, "key").collect()))
    assert a.columns == ["key", "id", "count", "twice"] and a.where("key = 7").count() == 1668


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from tessera.llm import components as C

    edges = [(1000, k) for k in range(500)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {**{k: 0 for k in [*range(500), 1000]}, **{k: 2000 for k in range(2000, 2061)}}
    for hub in (C.HUB, 20):
        monkeypatch.setattr(C, "HUB", hub)
        assert {r.node: r.component for r in components(df).collect()} == want
