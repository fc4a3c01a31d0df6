"""The pipeline against a brute-force version on a small fixture."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import simhash
from tessera.llm.common import BATCH_KEY, BATCH_ROWS
from tessera.llm.queries import vocabulary

from .test_decontaminate import brute as overlaps
from .test_line_dedup import brute as dedup


def fixture():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ta", "ro", "li") for b in ("mon", "ste", "gra") for c in ("ne", "do", "x", "ch")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared, items = line(60), [(1, line(25)), (2, line(12))]
    docs = []
    for i in range(30):
        body = "\n".join(line(40) for _ in range(3))
        if i % 5 == 1:
            body += "\n" + shared
        if i % 7 == 2:
            body += "\nbefore " + items[0][1] + " after"
        docs.append((i, body, "en" if i % 2 else "fr", "s", len(body)))
    near = docs[3][1].replace("\n", " ").split()  # one line, so that line dedup leaves it
    docs.append((40, " ".join([*near[:60], "changed", *near[61:]]), "en", "s", 1))
    docs.append((41, docs[4][1], "en", "s", 1))  # a copy
    docs += [(42, None, "en", "s", None), (43, "", None, "s", 0), (44, "12 34 -- 56", "fr", "s", 11)]
    docs.append((45, " ".join([*near[:30], "altered", *near[31:]]), "en", "s", 1))
    return docs, items


def brute(docs, items):
    texts = {d: t for d, t, *_ in docs if t and any(c.isalpha() for c in t)}
    left = dedup(sorted(texts.items()))
    texts = {d: t for d, t in left.items() if t.strip(" \n")}
    sets = {d: set(simhash.shingles(t, simhash.NEAR_SHINGLE)) for d, t in texts.items()}
    kept = {}
    for d in sorted(texts):
        if not any(len(sets[d] & sets[o]) / len(sets[d] | sets[o]) >= 0.8 for o in kept):
            kept[d] = texts[d]
    found = overlaps(list(kept.values()), items)
    kept = {d: t for (d, t), f in zip(kept.items(), found) if not f[1]}
    library, out = Tokenizer.from_file(vocabulary()), {}
    for d, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        out[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = C.run(spark, str(tmp_path))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()} == brute(docs, items)


def test_stages_keep_columns_and_take_no_rows(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert C.STAGES[-1][1](spark, df.limit(0), str(tmp_path)).count() == 0


def test_workers_get_few_texts_at_once(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many = spark.range(3 * BATCH_ROWS, numPartitions=1).selectExpr("id AS doc_id", "'a few words of text' AS text", "'en' AS lang", "'s' AS source", "19L AS n_chars")
    rows = F.arrow_udf(lambda ids: pa.array([len(ids)] * len(ids)), "bigint")
    for name, stage in C.STAGES:
        if name == "line_dedup":  # has no Python
            continue
        spark.conf.unset(BATCH_KEY)
        try:
            stage(spark, many, str(tmp_path))
            assert many.select(rows("doc_id").alias("n")).agg(F.max("n")).head()[0] <= BATCH_ROWS, name
        finally:
            spark.conf.unset(BATCH_KEY)
