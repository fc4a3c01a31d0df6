"""Spelling variants: words within one edit, found in forward and reversed sorted dictionaries (operator 13).

One inserted, deleted or replaced code point leaves a half of a word intact. So each word is in a forward dictionary under its first half and
in a reversed one under its last half, as the shorter of a pair (with words of its length) and as the longer (with words one code point
shorter). Both are sorted; a block is a range of words of one length and the next that share the prefix or the suffix. Blocks of more than
BLOCK words are subdivided: what the prefix and suffix leave between them has halves of its own, one of which is intact, so their words are dealt
to longer prefixes and longer suffixes, in the next round, until blocks are small or leave no more than one code point of the shorter word open.
(Then what is in a block is bounded by the letters there are.) Pairs of a block are verified whole, many at once.

Each pair is in one block only: a block that was dealt by a suffix leaves out pairs whose common prefix puts them under the other half.

Words are counted where they are read, so no word's occurrences meet in one task; blocks are never larger than BLOCK or what one open code
point allows; only words, not texts, are shuffled after the count.

Results: near words are counted in full, with no limit. Ties of the most frequent near word go to the smallest in code-point order, which is the order of
UTF-8 bytes. Null and empty texts have no words; very long runs are words like others. A null id is written `null` in what is hashed for typing errors. Repeated rows count again.
No documents: no rows. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, give_back, written

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has at least so many times the occurrences of its variants.
TIMES = 5
#: One in so many runs of a document has an error put in.
ERRORS = 199
#: Words of a block, above which it is subdivided.
BLOCK = 256
#: Pairs times code points that are compared at once.
CELLS = 4_000_000
FIELDS = ["m", "head", "tail", "cap"]
LINK = "word string, other string, other_n bigint"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int | None = ERRORS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of enough code points and occurrences. errors: one in so many runs of a document, by their checksum, loses a code point."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))  # whole runs, as matches are greedy
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    if errors:
        h, size = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")), F.char_length("run")
        at = (h % size).cast("int")
        less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
        runs = runs.select(F.when(h % errors == 0, less).otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _entry(m: Column, head: Column, tail: Column, cap: Column) -> Column:
    """Place of a word in a dictionary: the shorter word's length, the shared prefix and suffix, and the common prefix that pairs stay below."""
    return F.struct(m.cast("int").alias("m"), head.alias("head"), tail.alias("tail"), cap.cast("int").alias("cap"))


def _start(size: Column) -> Column:
    return F.substring(F.col("word"), F.lit(1), size.cast("int"))


def _end(size: Column) -> Column:
    return F.substring(F.col("word"), (F.char_length("word") - size + 1).cast("int"), size.cast("int"))


def dictionaries(counted: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n and the places of each word in the forward and the reversed dictionary."""
    size, none, found = F.char_length("word"), F.lit(""), []
    for m in (size, size - 1):
        half = F.floor(m / 2)
        found.append(F.when(m >= least_length, F.array(_entry(m, _start(half), none, m + 1), _entry(m, none, _end(half), half))).otherwise(F.array().cast("array<struct<m:int,head:string,tail:string,cap:int>>")))
    return counted.select("word", "n", F.inline(F.concat(*found)))


def subdivided(entries: DataFrame) -> DataFrame:
    """Entries under a prefix or a suffix that is longer by half of what is open; which one a pair is under, its common prefix says."""
    head, tail = F.char_length("head"), F.char_length("tail")
    half = F.floor((F.col("m") - head - tail) / 2)
    deeper = F.array(
        _entry(F.col("m"), _start(head + half), F.col("tail"), F.col("cap")),
        _entry(F.col("m"), F.col("head"), _end(tail + half), F.least(F.col("cap"), head + half)),
    )
    return entries.select("word", "n", F.inline(deeper))


def _codes(some: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, filled up with zeros."""
    return np.array(some, f"<U{width}").view(np.uint32).reshape(len(some), width)


def _near(a: np.ndarray, b: np.ndarray, m: int, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(within one edit, common prefix) of rows a of m code points and rows b of m, or of m + 1 where longer."""
    head = np.logical_and.accumulate(a[:, :m] == b[:, :m], axis=1).sum(1)
    even = np.logical_and.accumulate((a[:, :m] == b[:, :m])[:, ::-1], axis=1).sum(1)
    later = np.logical_and.accumulate((a[:, :m] == b[:, 1 : m + 1])[:, ::-1], axis=1).sum(1)
    return np.where(longer, head + later >= m, (head < m) & (head + even >= m - 1)), head


def _pairs(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs within blocks of these sizes, about `most` at once: each word with all after it."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(ends)) - 1
    total = np.cumsum(after)
    a = 0
    while a < len(after):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        n = after[a:z]
        first = np.repeat(np.arange(a, z), n)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        a = z


def _scanned(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of whole blocks, which stand together in a sorted table: both ways."""
    keys = np.zeros(table.num_rows, bool)
    keys[:1] = True
    for name in FIELDS:
        c = table.column(name).combine_chunks()
        keys[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    starts = np.append(np.nonzero(keys)[0], table.num_rows)
    sizes = np.diff(starts)
    many = np.repeat(sizes > 1, sizes)
    table, sizes = table.filter(pa.array(many)), sizes[sizes > 1]
    length, block_ends = table.column("m").to_numpy(), np.cumsum(sizes)
    word, n, cap = table.column("word").combine_chunks(), table.column("n").to_numpy(), table.column("cap").to_numpy()
    at, block = 0, 0
    while block < len(sizes):  # blocks of one length
        m = int(length[at])
        end = int(np.searchsorted(length, m, "right"))
        last = int(np.searchsorted(block_ends, end, "left")) + 1
        some = word.slice(at, end - at).to_pylist()
        for part, own in _cut(some, sizes[block:last], max(1, CELLS // (m + 1))):
            codes = _codes(some[part], m + 1)
            longer = codes[:, m] != 0
            for i, j in _pairs(own, max(1, CELLS // (m + 1))):
                swap = longer[i] & ~longer[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                both = ~longer[i]
                i, j = i[both], j[both]
                near, head = _near(codes[i], codes[j], m, longer[j])
                near &= head < cap[at + part.start : at + part.stop][i]
                i, j = i[near] + at + part.start, j[near] + at + part.start
                ends, others = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                if len(ends):
                    yield pa.RecordBatch.from_arrays([word.take(ends), word.take(others), pa.array(n[others.to_numpy()], pa.int64())], ["word", "other", "other_n"])
        at, block = end, last


def _cut(some: list[str], sizes: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Whole blocks with about `most` words together."""
    a = k = 0
    ends = np.cumsum(sizes)
    while k < len(sizes):
        z = max(k + 1, int(np.searchsorted(ends, a + most, "right")))
        yield slice(a, int(ends[z - 1])), sizes[k:z]
        a, k = int(ends[z - 1]), z


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the blocks of a sorted dictionary: the last block of a batch waits for the next batch."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, bool)
        for name in FIELDS:
            c = t.column(name)
            same &= pc.equal(c, c[-1]).to_numpy()
        start = t.num_rows - int(same[::-1].argmin()) if not same.all() else 0  # of the last block
        yield from _scanned(t.slice(0, start))
        held = t.slice(start)
    if held is not None:
        yield from _scanned(held)
    give_back()


def links(counted: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """word, other, other_n: every pair of words within one edit, both ways, once."""
    entries, found = written(dictionaries(counted, least_length), "dictionaries"), []
    while True:
        counts = written(entries.groupBy(*FIELDS).count().where("count > 1"), "blocks")
        open_ = F.col("m") - F.char_length("head") - F.char_length("tail") > 1
        large = counts.where((F.col("count") > block) & open_).select(*FIELDS)
        if some := large.count():
            large = F.broadcast(large) if some <= HOT_KEYS else large
        small = entries.join(large, FIELDS, "left_anti") if some else entries
        parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ordered = small.repartitionByRange(parts, *FIELDS).sortWithinPartitions(*FIELDS, "word")
        found.append(written(ordered.select(*FIELDS, "word", "n").mapInArrow(scan, LINK), "word-links"))
        if not some:
            break
        entries = written(subdivided(entries.join(large, FIELDS, "left_semi")), "dictionaries")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the last of the forms that follow each other. Each round doubles the way."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not after.agg(F.max("moved")).head()[0]:
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int | None = ERRORS, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word."""
    counted = written(words(docs, id_col, text_col, errors), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = links(counted, LEAST_LENGTH, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = counted.join(near, "word", "left")
    enough = -F.col("best.n") >= TIMES * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    forms = written(forms, "forms")
    last = roots(forms.where("form is not null"))
    return forms.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
