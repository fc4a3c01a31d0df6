"""Token files: exact round trips."""

import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm import token_files as T
from tessera.llm.common import upload
from tessera.llm.queries import END_ID, vocabulary


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_round_trip_of_a_file(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 30, n), rng.integers(100, 900, n))
    ends = np.unique(np.append(rng.integers(0, n + 1, 9), n))
    f = T.TokenFile(T.write_file(ids, ends, [None, *range(len(ends) - 1)]))
    assert f.keys == [None, *range(len(ends) - 1)] and f.ends.tolist() == ends.tolist()
    assert (f.ids(0, n) == ids).all()
    for a, b in rng.integers(0, n + 1, (20, 2)).tolist():
        assert (f.ids(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_blocks_of_one_value_need_no_bits():
    f = T.TokenFile(T.write_file(np.full(1000, 7), np.array([1000]), [1]))
    assert f.body.size == 0 and (f.ids(0, 1000) == 7).all()


def test_files_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 50)
    texts = {5: "one two three", 3: None, 9: "", 1: "again and again " * 30, -4: "l'été <|endoftext|>", 7: "x"}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id bigint, text string, start int")
    folder, made = T.write(df, vocabulary(), END_ID)
    files = T.offsets(made)
    library, start, want = Tokenizer.from_file(vocabulary()), 0, []
    for k in sorted(texts):
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids + [END_ID]
        want.append((k, start, len(ids), ids))
        start += len(ids)
    assert [tuple(r) for r in T.read(spark, folder, files).orderBy("key").collect()] == want
    crc = {r.key: r.ids_crc32 for r in T.read_digests(spark, folder, files).collect()}
    assert crc == {k: zlib.crc32(np.array(ids, "<u4").tobytes()) for k, _, _, ids in want}


def test_repeated_and_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(2, "b"), (2, "b"), (None, "n"), (2, "c")], "doc_id bigint, text string")
    folder, made = T.write(df, vocabulary(), END_ID)
    rows = T.read(spark, folder, T.offsets(made)).orderBy("start").collect()
    assert [r.key for r in rows] == [None, 2, 2, 2] and [r.start for r in rows] == [0, 2, 4, 6]
    folder, made = T.write(df.limit(0), vocabulary(), END_ID)
    assert T.read(spark, folder, T.offsets(made)).count() == 0


def test_other_vocabularies_encode_whole_texts(tmp_path):
    """A cased vocabulary with word ends passes for one that parts words only if its configuration says so."""
    with open(vocabulary(), encoding="utf-8") as f:
        config = json.load(f)
    config["normalizer"] = {"type": "Sequence", "normalizers": config["normalizer"]["normalizers"][:2]}
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
    library, plain = T.Library(path), Tokenizer.from_file(path)
    assert not library.parted and T.Library(vocabulary()).parted
    for text in ("Hello World CD Ab", "l'Été  x", ""):
        assert np.frombuffer(library.encode(text), "<i4").tolist() == plain.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.WordBpe(path)


def test_long_documents_and_left_over_files(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 1000)
    monkeypatch.setattr(T, "TASK_BYTES", 4000)
    df = spark.createDataFrame([(k, f"word{k} and more " * (3000 if k == 5 else k)) for k in range(12)], "doc_id bigint, text string")
    folder, made = T.write(df, vocabulary(), END_ID)
    files = T.offsets(made)
    upload(f"{folder}/99999999-000000.pfor", T.write_file(np.array([7]), np.array([1]), [3]))
    rows, library, start = T.read(spark, folder, files).orderBy("key").collect(), Tokenizer.from_file(vocabulary()), 0
    for r, (k, text) in zip(rows, df.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [END_ID]
        assert (r.key, r.start, r.ids) == (k, start, ids)
        start += len(ids)


def test_query(spark, sf):
    from tessera.llm.queries import op3_token_files, table

    library, start = Tokenizer.from_file(vocabulary()), 0
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op3_token_files(spark, sf).collect()}
    for d in table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [END_ID]
        assert found[d.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
