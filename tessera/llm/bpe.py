"""BPE encoding and decoding (operator 2).

Encoding is the backtracking algorithm: an Aho-Corasick automaton gives the longest token at each place of a word; a
candidate is taken if it is compatible with the token before it, that is, if byte-pair merging would itself leave these
two tokens side by side, else the next shorter token of that place is tried, or the last one is taken back. Each place
is left for good at most once, so the work is linear in the word. Decoding gathers token strings by an offset table.

Words are independent of each other in such vocabularies (no token spans white space), and so are the pre-tokens of a word, so their
tokens are kept in tables of bounded size and long texts cost a lookup for each pre-token. Texts of ASCII and Latin letters are cut into
pre-tokens in one go; others word by word.

Results: null and empty texts have no tokens and decode to the empty string; the strings of added tokens in a text are
these tokens; repeated rows are encoded alike; columns of the input with the name of a new column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns

#: Words that each worker keeps encoded; beyond it the table starts anew.
KEPT_WORDS = 200_000
KEPT_PAIRS = 200_000
#: Ids that are decoded at once.
DECODED_AT_ONCE = 500_000
#: The Unicode white space that the vocabularies' normalizer folds. str.split() knows the four others of ODD too.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
#: The pre-tokens of lower-case text below U+0130, where normalization only changes the case.
PLAIN = re.compile("[!-~\xa1-\u012f]+")
PLAIN_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f0-9\xb2\xb3\xb9\xbc-\xbe]+")

#: The same pre-tokens in whole texts of such words and white space.
_WHITE = SPACE.pattern[1:-2]
PLAIN_TEXT = re.compile(f"[{_WHITE}!-~\xa1-\u012f]*")
_TEXT_TOKENS = re.compile(PLAIN_TOKENS.pattern[:-2] + _WHITE + "]+")
_NO_APOSTROPHE = re.compile(_TEXT_TOKENS.pattern.removeprefix("'s|'t|'re|'ve|'m|'ll|'d|"))
#: The normalizer and pre-tokenizer of vocabularies with word ends, in the library's JSON.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(config: dict) -> bool:
    """Whether a tokenizer, as the library's JSON gives it, takes the words of a text one by one, in lower case, as words() and PLAIN_TOKENS part them."""
    model = config["model"]
    added = all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in config["added_tokens"])
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    same = config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == PRE_TOKENIZER and not config["post_processor"] and not config["decoder"]
    return bool(added and plain and same and model["type"] == "BPE" and model.get("end_of_word_suffix"))


def text_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that PLAIN_TEXT matches, in lower case."""
    return (_TEXT_TOKENS if "'" in text else _NO_APOSTROPHE).findall(text.lower())


def words(text: str) -> list[str]:
    """Runs of what isn't white space."""
    return [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()


class Kept:
    """Bytes by string, made as they are asked for. At most `most` are kept: when half of them are new, those not asked for since go."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = most // 2

    def join(self, found: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> bytes:
        """The bytes of all strings, one after the other."""
        self.load(found, make)
        return b"".join(map(self.young.__getitem__, found))

    def load(self, found: Iterable[str], make: Callable[[list[str]], Iterable[bytes]]) -> None:
        new = set(found).difference(self.young)
        if not new:
            return
        if len(self.young) + len(new) > self.half:
            self.old, self.young = self.young, {}
            new = set(found)
        old = self.old
        missing = [w for w in new if w not in old]
        self.young.update([(w, old[w]) for w in new if w in old])
        self.young.update(zip(missing, make(missing)))


class OffsetTable:
    """Strings by id in one buffer: the bytes of id i, and a space, start at offsets[i]."""

    def __init__(self, strings: list[bytes]):
        self.buffer = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)
        self.lengths = np.diff(self.offsets)

    def join(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """For each run of ids, which ends at ends: their strings, joined by one space."""
        out, first, start = [], 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, start + DECODED_AT_ONCE, "right")))
            part = ids[start : ends[last - 1]]
            size = self.lengths[part]
            stop = np.cumsum(size)
            at = np.repeat(self.offsets[part] - stop + size, size)
            at += np.arange(len(at))
            raw = self.buffer[at].tobytes()
            cuts = np.concatenate([[0], stop])[np.concatenate([[start], ends[first:last]]) - start]
            out += [raw[a : b - 1] if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            first, start = last, int(ends[last - 1])
        return out


class WordBpe:
    """A BPE model with word ends in the tokenizers library's JSON, whose ids are the order of its merges."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if not by_words(config):
            raise ValueError(f"{path} isn't a lower-case vocabulary with word ends")
        model, library = config["model"], Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        strings: list[str] = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in [*vocab.items(), *self.added.items()]:
            strings[i] = t
        self.strings = strings
        mark = lambda t: self.marked(t.removesuffix(suffix)) if suffix and t.endswith(suffix) else t
        ids = {mark(t): i for t, i in vocab.items()}
        self.length = [0] * len(strings)
        self.left, self.right = list(range(len(strings))), list(range(len(strings)))
        self.prefix = [-1] * len(strings)
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in model["merges"]:
            self.pairs[vocab[a], vocab[b]] = i = vocab[a + b]
            self.left[i], self.right[i] = vocab[a], vocab[b]
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.length[i] = len(t)
            self.automaton.add_word(t, (i, len(t)))
            self.prefix[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self.automaton.make_automaton()
        self.ids, self.checked = ids, {}
        self.packed = [array("i", [i]).tobytes() for i in range(len(strings))]
        self.kept, self.kept_pieces = Kept(KEPT_WORDS // 4), Kept(KEPT_WORDS)
        self.pieces = lru_cache(KEPT_WORDS // 4)(self.piece)
        symbols = [self.pre_tokenize(chr(c))[0][0] if 0x20 < c < 0x7F else "" for c in range(256)]
        for c in range(0x80, 0x800, 0x40):  # each lead byte and, below, each byte that follows one
            lead = self.pre_tokenize(chr(c))
            symbols[chr(c).encode()[0]] = "".join(x for x, _ in lead)[0] if lead else ""
        for c in range(0x180, 0x1C0):
            symbols[chr(c).encode()[1]] = self.pre_tokenize(chr(c))[0][0][1]
        self.symbols = {b: s for b, s in enumerate(symbols) if s}
        self.plain = all("".join(x for x, _ in self.pre_tokenize(chr(c))) == self.bytewise(chr(c)) for c in [*range(0x21, 0x7F), *range(0xA1, 0x130)])
        self.texts = OffsetTable([s.encode() for s in strings])
        self.decimals = OffsetTable([str(i).encode() for i in range(len(strings))])

    @staticmethod
    def marked(symbols: str) -> str:
        """The last symbol of a word is another one than the same symbol inside it."""
        return symbols[:-1] + chr(ord(symbols[-1]) + 0xE000) if symbols else symbols

    def bytewise(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.symbols)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: no merge across their border comes before those that build them."""
        limit = 1 << 60
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            undo_left = a > b  # the later merge of the two is undone first
            for _ in range(2):
                if undo_left:
                    limit, part = a, self.right[a]
                    if part != a:
                        a = part
                        break
                else:
                    limit, part = b + 1, self.left[b]
                    if part != b:
                        b = part
                        break
                undo_left = not undo_left
            else:
                return True

    def piece(self, symbols: str) -> bytes:
        """Tokens of one pre-token, given in the vocabulary's symbols, as 32-bit integers."""
        s = self.marked(symbols)
        if s in self.ids:  # the longest token at the start, with nothing before it
            return self.packed[self.ids[s]]
        n = len(s)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(s):
            longest[end - size + 1] = token  # ends ascend: the longest stays
        length, prefix, checked = self.length, self.prefix, self.checked
        out: list[int] = []
        left_for_good, at, token, before = set(), 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in left_for_good:
                    if before < 0:
                        break
                    if (fine := checked.get((before, token))) is None:
                        fine = self.compatible(before, token)
                    if fine:
                        break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"no token for {symbols!r}")
                left_for_good.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
        return array("i", out).tobytes()

    def compatible(self, a: int, b: int) -> bool:
        """The entry (a, b) of the pair-compatibility table, which is filled as pairs are met."""
        if len(self.checked) >= KEPT_PAIRS:
            self.checked.clear()
        self.checked[a, b] = fine = self._compatible(a, b)
        return fine

    def word(self, word: str) -> bytes:
        """Tokens of a run without white space; added tokens are cut out first."""
        if self.split_added and any(t in word for t in self.added):
            return b"".join(self.packed[self.added[p]] if p in self.added else self.word(p) for p in self.split_added.split(word) if p)
        if not self.plain or not PLAIN.fullmatch(word):
            return b"".join([self.pieces(p) for p, _ in self.pre_tokenize(self.normalize(word))])
        return b"".join([self.pieces(p if p.isascii() else self.bytewise(p)) for p in PLAIN_TOKENS.findall(word.lower())])

    def encode(self, text: str | None) -> bytes:
        """Ids as 32-bit integers."""
        if not text:
            return b""
        if self.plain and PLAIN_TEXT.fullmatch(text) and not any(t in text for t in self.added):
            return self.kept_pieces.join(text_tokens(text), lambda missing: [self.piece(p if p.isascii() else self.bytewise(p)) for p in missing])
        return self.kept.join(words(text), lambda missing: map(self.word, missing))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return self.texts.join(ids, ends)


@lru_cache(1)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where those of each text end."""
    encode = model(path).encode
    runs = [encode(t.as_py()) for t in texts]
    return np.frombuffer(b"".join(runs), "<i4"), np.cumsum([len(r) // 4 for r in runs], dtype=np.int64) if runs else np.zeros(0, np.int64)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int) and n_tokens (long)."""

    def run(texts: pa.Array) -> pa.Array:
        ids, ends = encoded(path, texts)
        return pa.StructArray.from_arrays([_lists(ids, ends), pa.array(np.diff(ends, prepend=0), pa.int64())], ["ids", "n_tokens"])

    return append_columns(docs, [text_col], run, "ids array<int>, n_tokens bigint")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the decoded text of ids_col; a null list decodes to the empty string."""

    def run(lists: pa.Array) -> pa.Array:
        size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
        out = model(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size))
        return pa.StructArray.from_arrays([pa.array([x.decode() for x in out], pa.string())], [to])

    return append_columns(rows, [ids_col], run, f"`{to}` string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded, and decoded from the ids, without ids or texts leaving the worker."""

    def run(texts: pa.Array) -> pa.Array:
        ids, ends = encoded(path, texts)
        m, sha = model(path), lambda x: hashlib.sha256(x).hexdigest()
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(map(sha, m.decimals.join(ids, ends)), pa.string()), pa.array(map(sha, m.decode(ids, ends)), pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return append_columns(docs, [text_col], run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
