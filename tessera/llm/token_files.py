"""Token-ID files (operator 3): patched frame-of-reference blocks.

Rows are range-partitioned by id and each task writes its documents' ids, in order, to files of bounded size. In a file,
ids are cut into blocks of BLOCK; a block keeps its minimum, packs what is left of each id at the width that PERCENTILE of
them need, and lists the others (place and whole difference) as exceptions. An index holds where each block starts.

Layout, little-endian: MAGIC; block size (u32), blocks (u32), ids (u64), documents (u64), packed bytes (u64); document ids (i64)
and whether they are null (u8); where each document ends (u64); each block's minimum (u32), width (u8), start in the packed
bytes (u64) and first exception (u64, one more than blocks); exceptions' places (u8) and differences (u32); packed bytes, where
blocks of one width lie together in their order, so that they are packed and read at once.

Results: null and empty texts have only the end id; null document ids come first; rows with equal document ids all keep
their own entry, side by side, ordered by a hash of the text; an empty table makes no file. A document of more than FILE_IDS ids is a
file of its own. A task that is repeated writes the same files; what else is in a folder isn't read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PLAIN, PLAIN_TEXT, PLAIN_TOKENS, Kept, by_words, text_tokens, words
from .common import scratch, upload

MAGIC = b"TSPFOR1\0"
BLOCK = 128
PERCENTILE = 90
#: Ids in a file, beyond which the next document starts another one.
FILE_IDS = 4_000_000
TEXTS_AT_ONCE = 64
#: Words, and pieces of words, that each worker keeps encoded.
KEPT_WORDS = 400_000
#: Bytes of text for a task.
TASK_BYTES = 32 << 20


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 4 * width 32-bit words: value i of a row starts at bit i * width."""
    out = np.zeros((BLOCK * width // 32, len(values)), np.uint32)
    columns = np.ascontiguousarray(values.T.astype(np.uint32))
    for i in range(BLOCK):
        word, shift = divmod(i * width, 32)
        out[word] |= columns[i] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= columns[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.astype("<u4", copy=False).T)


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(packed.T).astype(np.uint64)
    out, mask = np.empty((BLOCK, len(packed)), np.uint64), np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 32)
        wide = columns[word] | (columns[word + 1] << np.uint64(32) if shift + width > 32 else np.uint64(0))
        out[i] = wide >> np.uint64(shift) & mask
    return out.T


def write_file(ids: np.ndarray, ends: np.ndarray, keys: list[int | None]) -> bytes:
    """One file of all ids; document i ends before ids[ends[i]]."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.int32)  # ids of vocabularies are far below 2**31
    padded[: len(ids)] = ids
    if len(ids) % BLOCK:
        padded[len(ids) :] = padded[len(ids) - 1]
    rows = padded.reshape(n, BLOCK)
    least = rows.min(1) if n else np.zeros(0, np.int32)
    rest = rows - least[:, None]
    place = BLOCK * PERCENTILE // 100 - 1
    typical = np.partition(rest, place, axis=1)[:, place] if n else least
    width = np.ceil(np.log2(typical + 1.0)).astype(np.uint8)
    over = rest >= (1 << width.astype(np.int32))[:, None]
    first = np.concatenate([[0], np.cumsum(over.sum(1))]) if n else np.zeros(1, np.int64)
    places = np.nonzero(over)[1].astype(np.uint8)
    outliers = rest[over].astype("<u4")
    rest[over] = 0
    body, starts, at = [], np.zeros(n, np.int64), 0
    for w in np.unique(width[width > 0]).tolist():
        of = np.nonzero(width == w)[0]
        body.append(_packed(rest[of], w))
        starts[of] = at + np.arange(len(of)) * (w * BLOCK // 8)
        at += body[-1].nbytes
    null = np.array([k is None for k in keys], np.uint8)
    head = MAGIC + struct.pack("<IIQQQ", BLOCK, n, len(ids), len(keys), at)
    parts = [np.array([k or 0 for k in keys], "<i8"), null, np.asarray(ends, "<u8"), least.astype("<u4"), width, starts.astype("<u8"), first.astype("<u8"), places, outliers, *body]
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reads a file's bytes; single blocks and documents without the others."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        block, n, self.count, docs, size = struct.unpack_from("<IIQQQ", data, 8)
        if block != BLOCK:
            raise ValueError(f"blocks of {block} ids")
        at = 40

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, size, at)
            at += out.nbytes
            return out

        keys, null = take("<i8", docs), take("u1", docs)
        self.keys = [None if x else k for k, x in zip(keys.tolist(), null.tolist())]
        self.ends = take("<u8", docs).astype(np.int64)
        self.least, self.width = take("<u4", n), take("u1", n)
        self.starts, self.first = take("<u8", n).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.places, self.outliers = take("u1", int(self.first[-1])), take("<u4", int(self.first[-1]))
        self.body = take("u1", size)

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """The ids of blocks lo to hi - 1, padding included."""
        out = np.zeros((hi - lo, BLOCK), np.int64)
        width, starts = self.width[lo:hi], self.starts[lo:hi]
        for w in np.unique(width[width > 0]).tolist():
            of = np.nonzero(width == w)[0]
            a, size = int(starts[of[0]]), w * BLOCK // 8
            out[of] = _unpacked(self.body[a : a + len(of) * size].reshape(len(of), size).view("<u4"), w)
        a, b = self.first[lo], self.first[hi]
        of = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        out[of, self.places[a:b]] = self.outliers[a:b]
        return (out + self.least[lo:hi, None]).ravel()

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        if a >= b:
            return np.zeros(0, np.int64)
        lo, hi = a // BLOCK, -(-b // BLOCK)
        return self.blocks(lo, hi)[a - lo * BLOCK : b - lo * BLOCK]


class Library:
    """A tokenizer of the tokenizers library. Of vocabularies that part texts by words it is asked for each word or piece once; others encode whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        suffix, self.parted = config["model"].get("end_of_word_suffix"), by_words(config)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.added = [t["content"] for t in config["added_tokens"]]
        self.words, self.pieces = Kept(KEPT_WORDS // 4), Kept(KEPT_WORDS)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """Ids as 32-bit integers."""
        if not text:
            return b""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if not self.parted:
            return [np.array(self._encode(t), "<i4").tobytes() if t else b"" for t in texts]
        plain = [bool(t) and PLAIN_TEXT.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        # pre-tokens of texts of ASCII and Latin letters at once; others by words
        pieces = [text_tokens(t) if p else [] for t, p in zip(texts, plain)]
        self.pieces.load({x for xs in pieces for x in xs}, self._pieces)
        kept = self.pieces.young.__getitem__
        out = [b"".join(map(kept, xs)) for xs in pieces]
        for i, (t, p) in enumerate(zip(texts, plain)):
            if t and not p:
                found = words(t)
                self.words.load(set(found), self._words)
                out[i] = b"".join(map(self.words.young.__getitem__, found))
        return out

    def _words(self, missing: list[str]) -> list[bytes]:
        parts = [PLAIN_TOKENS.findall(w.lower()) if PLAIN.fullmatch(w) and "<" not in w else None for w in missing]
        self.pieces.load([p for ps in parts if ps for p in ps], self._pieces)
        kept = self.pieces.young
        return [np.array(self._encode(w), "<i4").tobytes() if ps is None else b"".join([kept[p] for p in ps]) for w, ps in zip(missing, parts)]

    def _pieces(self, missing: list[str]) -> list[bytes]:
        """One call for all pieces: each ends in the only token with a word end that it has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<i4")
        ends = np.nonzero(self.last[ids])[0] + 1 if len(ids) else np.zeros(0, int)
        if len(ends) != len(missing):
            return [np.array(self._encode(p), "<i4").tobytes() for p in missing]
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:z] for a, z in zip(cuts, cuts[1:])]


@lru_cache(1)
def _library(path: str) -> Library:
    return Library(path)


def write(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes docs' ids in ascending order of id_col to files of a new shared folder. Gives the folder and, for each file, its
    name, place in the order, documents and ids (a row a file: what the driver may gather)."""
    spark = docs.sparkSession
    to = scratch(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).head()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    placed = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        runs: list[bytes] = []
        size = 0
        tail = np.array([end_id], "<i4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal keys, runs, size, count
            data = write_file(np.frombuffer(b"".join(runs), "<i4"), np.cumsum([len(r) // 4 for r in runs]), keys)
            name = f"{task:08d}-{count:06d}.pfor"
            upload(f"{to}/{name}", data)
            out = pa.RecordBatch.from_pydict({"file": [name], "task": [task], "part": [count], "docs": [len(keys)], "ids": [size]}, schema=pa.schema([("file", pa.string()), ("task", pa.int64()), ("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))
            keys, runs, size, count = [], [], 0, count + 1
            return out

        for b in batches:
            for a in range(0, b.num_rows, TEXTS_AT_ONCE):
                some = b.slice(a, TEXTS_AT_ONCE)
                for k, ids in zip(some.column(0).to_pylist(), _library(path).encode_many(some.column(1).to_pylist())):
                    ids += tail
                    if runs and size + len(ids) // 4 > FILE_IDS:
                        yield flush()
                    keys.append(k)
                    runs.append(ids)
                    size += len(ids) // 4
        if runs:
            yield flush()

    return to, placed.mapInArrow(run, "file string, task bigint, part bigint, docs bigint, ids bigint")


def read(spark, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """One row a document of the files (name, ids in all files before): key, start, n_tokens, ids."""
    return _read(spark, folder, files, "ids array<int>", lambda runs: pa.array(runs, pa.list_(pa.int32())))


def read_digests(spark, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """As read(), with the unsigned crc32 of the ids as little-endian unsigned 32-bit integers in place of them."""
    return _read(spark, folder, files, "ids_crc32 bigint", lambda runs: pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in runs], pa.int64()))


def _read(spark, folder: str, files: list[tuple[str, int]], field: str, column) -> DataFrame:
    schema = f"key bigint, start bigint, n_tokens bigint, {field}"
    if not files:
        return spark.createDataFrame([], schema)
    before = dict(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                if name not in before:
                    continue
                f, base = TokenFile(data.as_py()), before[name]
                ends = f.ends
                for lo in range(0, len(ends), 4096):
                    hi = min(lo + 4096, len(ends))
                    a = int(ends[lo - 1]) if lo else 0
                    ids, stops = f.ids(a, int(ends[hi - 1])), ends[lo:hi] - a
                    starts = np.concatenate([[0], stops[:-1]])
                    runs = [ids[x:y] for x, y in zip(starts.tolist(), stops.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(f.keys[lo:hi], pa.int64()), pa.array(base + a + starts), pa.array(stops - starts), column(runs)], ["key", "start", "n_tokens", field.split()[0]])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    return content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def offsets(files: DataFrame) -> list[tuple[str, int]]:
    """Each file with the number of ids in the files before it. It gathers a row a file, not a row a document."""
    out, total = [], 0
    for r in sorted(files.collect(), key=lambda r: (r.task, r.part)):
        out.append((r.file, total))
        total += r.ids
    return out
