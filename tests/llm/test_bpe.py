"""BPE against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, token_files
from tessera.llm.queries import vocabulary

CHARACTERS = "abcdefghijklmnopqrstuvwxyz'ABCéßüñÀΣςİ　\xa0\x1c\x85🙂漢字!?.,-_0123456789Ⅷ́ "


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def texts(seed, n=1500):
    rng = random.Random(seed)
    some = ["".join(rng.choice(CHARACTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return some + [None, "", " \n ", "foo<|endoftext|>bar <|startoftext|>", "<|EndOfText|>", "it's we'll don't I'd'''ss", "a" * 3000, "thethethe" * 300, "same", "same"]


def test_ids_and_decoded_texts_are_the_librarys(library):
    m = bpe.model(vocabulary())
    for seed in range(3):
        rows = texts(seed)
        want = [e.ids for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]
        got = [np.frombuffer(m.encode(t), "<i4").tolist() for t in rows]
        assert got == want
        ids, ends = np.array([i for w in want for i in w], np.int64), np.cumsum([len(w) for w in want])
        assert [d.decode() for d in m.decode(ids, ends)] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_small_tables_of_kept_words(library):
    m = bpe.WordBpe(vocabulary())
    m.kept = bpe.Kept(8)
    rows = texts(9, 200)
    assert [np.frombuffer(m.encode(t), "<i4").tolist() for t in rows] == [e.ids for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_operator(spark, library):
    rows = texts(4, 100)
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(rows)], "doc_id bigint, text string, IDS string")
    encoded = bpe.encode(df, vocabulary())
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    found = sorted(bpe.decode(encoded, vocabulary()).collect(), key=lambda r: r.doc_id)
    want = [e.ids for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert [r.ids for r in found] == want
    assert [r.n_tokens for r in found] == [len(w) for w in want]
    assert [r.decoded for r in found] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.round_trip(df.limit(0), vocabulary()).count() == 0


def test_odd_texts_as_the_library_encodes_them():
    library, m, files = Tokenizer.from_file(vocabulary()), bpe.WordBpe(vocabulary()), token_files.Library(vocabulary())
    odd = ["it's I'll 've 'RE don't x's", "a\x0bb\x85c\xa0d\u2028e\u3000f", "<|endoftext|> x<|startoftext|>y < | >", "ÀÉß ĮİI", "12½³ a1b2", "\x1c\x1dx", "'s 's'", "“q” …", " ", "\n\n", "e\u0301\u0301 x", "ªº¹ ÷×", "aİb", "don’t 東京 x", "a" * 5000, "ab " * 20_000]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(m.encode(text), "<i4").tolist() == ids and np.frombuffer(files.encode(text), "<i4").tolist() == ids, text[:40]
