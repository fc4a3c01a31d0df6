"""Benchmark decontamination (operator 1): suffix arrays over shards of the training texts.

Each task turns its documents into one sequence of word ids (a shard) and sorts the places of the shard by the words that
follow them: a suffix array, to the depth of the longest benchmark item. Every suffix of every item is then searched in it
by bisection. That gives its longest verbatim match in the shard with a location. Where it is as long as a window or longer, the
window with which the suffix starts occurs, and a second bisection gives the range of all its places.

Words outside the benchmark's vocabulary can't be in a match; they and the ends of documents are breaks, and places with
fewer words before the next break than the shortest window has are left out of the array.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES, one after the other: of each, the driver and the executors
hold one at a time, and what documents have is written to the shared folder in between.

Results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null and empty texts have none. An item of
fewer words than a window is one window, an item without words (or null) is none. Repeated items and documents count each;
items with a null id count and are named "null". An empty benchmark or table gives no hits or no rows. A text of more words than
a shard is a shard of its own, and is searched whole. overlaps() replaces columns with the name of a new one; decontaminate() keeps
all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, own_names, scratch, written

WINDOW = 10
#: Benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: Words in a shard, which ends with the document that passes it.
SHARD_WORDS = 1_500_000
QUERIES_AT_ONCE = 65_536
#: Bytes of UTF-8 that belong to words (a-z, 0-9, all beyond ASCII), A-Z in lower case, others as spaces.
FOLD = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Benchmark:
    """Item words as ids and the distinct windows with their items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names: list[str] = []
        runs, starts, sizes, owners = [], [], [], []
        at = 0
        for name, text in items:
            ids = [number(w, len(self.vocabulary)) for w in words(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            starts += range(at, at + len(ids) - size + 1)
            sizes += [size] * (len(ids) - size + 1)
            owners += [len(self.names)] * (len(ids) - size + 1)
            self.names.append("null" if name is None else str(name))
            runs += [*ids, -2]
            at += len(ids) + 1
        self.words = np.array(runs, np.int32)
        self.shortest = min(sizes, default=window)
        self.depth = int(np.diff(np.nonzero(self.words < 0)[0], prepend=-1).max(initial=2)) - 1
        kinds: dict[bytes, int] = {}
        self.at, self.size, self.items = [], [], []
        owner_kinds = []
        for a, n, owner in zip(starts, sizes, owners):
            kind = kinds.setdefault(self.words[a : a + n].tobytes(), len(self.at))
            if kind == len(self.at):
                self.at.append(a)
                self.size.append(n)
                self.items.append(set())
            self.items[kind].add(owner)
            owner_kinds.append(kind)
        self.at, self.size = np.array(self.at, np.int64), np.array(self.size, np.int64)
        #: All suffixes of items: places in words that aren't ends, their words, and the window each starts with (-1: too short).
        self.suffixes = np.nonzero(self.words >= 0)[0]
        ends = np.nonzero(self.words < 0)[0]
        self.sizes = ends[np.searchsorted(ends, self.suffixes)] - self.suffixes
        self.kinds = np.full(len(self.suffixes), -1, np.int64)
        self.kinds[np.searchsorted(self.suffixes, np.array(starts, np.int64))] = owner_kinds


class Shard:
    """A suffix array of a sequence of word ids, where negative ids are breaks."""

    def __init__(self, ids: np.ndarray, depth: int, shortest: int):
        self.ids = np.concatenate([ids, np.full(1, -1, np.int32)])
        n = len(self.ids)
        at = np.arange(n)
        #: Words from each place to the next break, and in the whole run between breaks.
        left = np.minimum.accumulate(np.where(self.ids < 0, at, n)[::-1])[::-1] - at
        run = left + at - np.maximum.accumulate(np.where(self.ids < 0, at, -1)) - 1
        live = np.nonzero((self.ids >= 0) & (run >= shortest))[0]
        # Ranks by the first word, then by twice as many words each time; where a suffix ends, the break comes first.
        rank = np.zeros(n, np.int64)
        rank[live] = self.ids[live] + 1
        near = 1
        while near < depth and len(live):
            behind = np.where(left[live] > near, rank[np.minimum(live + near, n - 1)], 0)
            key = rank[live] * (int(rank.max()) + 1) + behind
            order = np.argsort(key, kind="stable")
            ranks = np.concatenate([[1], 1 + np.cumsum(np.diff(key[order]) > 0)])
            rank[live[order]] = ranks
            near *= 2
            if ranks[-1] == len(live):
                break
        places = live[left[live] >= shortest]
        self.places = places[np.argsort(rank[places], kind="stable")]

    def bisect(self, bench: np.ndarray, at: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """For each query bench[at : at + size], how many suffixes come before it (or, after, before all that start with it)."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.places), np.int64)
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._less(self.places[mid], bench, at[open_], size[open_], after)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def _less(self, places: np.ndarray, bench: np.ndarray, at: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        common = self.common(places, bench, at, size)
        full = common == size
        inside = np.where(full, 0, common)
        here, there = self.ids[places + inside], bench[at + inside]
        return np.where(full, after, here < there)

    def common(self, places: np.ndarray, bench: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that the suffixes at these places and the queries have in common."""
        out, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            more = out[open_] < size[open_]
            open_ = open_[more]
            same = self.ids[places[open_] + out[open_]] == bench[at[open_] + out[open_]]
            open_ = open_[same]
            out[open_] += 1
        return out

    def longest(self, b: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of each item: its longest verbatim match of shortest or more words, and a place that has it (-1: none)."""
        sizes, at = np.zeros(len(b.suffixes), np.int64), np.full(len(b.suffixes), -1, np.int64)
        if not len(self.places):
            return sizes, at
        for k in range(0, len(b.suffixes), QUERIES_AT_ONCE):
            q, size = b.suffixes[k : k + QUERIES_AT_ONCE], b.sizes[k : k + QUERIES_AT_ONCE]
            after = self.bisect(b.words, q, size, False)
            for near in (np.maximum(after - 1, 0), np.minimum(after, len(self.places) - 1)):
                place = self.places[near]
                n = self.common(place, b.words, q, size)
                better = n > sizes[k : k + len(q)]
                sizes[k : k + len(q)][better], at[k : k + len(q)][better] = n[better], place[better]
        return sizes, at

    def windows(self, b: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """All (window, place) with an occurrence; at a place, the windows are of different sizes, so there are few."""
        sizes, _ = self.longest(b)
        whole = (b.kinds >= 0) & (sizes >= b.size[b.kinds]) if len(b.size) else np.zeros(0, bool)
        found = np.unique(b.kinds[whole])
        kinds, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(found), QUERIES_AT_ONCE):
            own = found[k : k + QUERIES_AT_ONCE]
            lo = self.bisect(b.words, b.at[own], b.size[own], False)
            n = self.bisect(b.words, b.at[own], b.size[own], True) - lo
            kinds.append(np.repeat(own, n))
            places.append(self.places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(kinds), np.concatenate(places)


def scan(texts: list[str | None], b: Benchmark) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: its words, the spans of words that windows cover (merged, ascending), and the items these are of."""
    out: list[tuple[int, list[tuple[int, int]], set[int]]] = []
    get, first = b.vocabulary.get, 0
    while first < len(texts):
        runs, sizes, at, last = [], [], [0], first
        while last < len(texts) and at[-1] < SHARD_WORDS:
            found = words(texts[last])
            sizes.append(len(found))
            ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
            runs += [ids, np.full(1, -1, np.int32)]
            at.append(at[-1] + len(found) + 1)
            last += 1
        found = [(n, [], set()) for n in sizes]
        shard = Shard(np.concatenate(runs), b.depth, b.shortest)
        kinds, places = shard.windows(b)
        if len(kinds):
            starts = np.array(at[:-1])
            docs = np.searchsorted(starts, places, "right") - 1
            edges = np.zeros(len(shard.ids) + 1, np.int64)
            np.add.at(edges, places, 1)
            np.add.at(edges, places + b.size[kinds], -1)
            cover = (np.cumsum(edges) > 0).astype(np.int8)
            turn = np.diff(cover, prepend=0)
            for a, z in zip(np.nonzero(turn > 0)[0].tolist(), np.nonzero(turn < 0)[0].tolist()):
                d = int(np.searchsorted(starts, a, "right")) - 1
                found[d][1].append((a - at[d], z - at[d]))
            pairs = np.unique(docs * len(b.at) + kinds)
            for d, k in zip((pairs // len(b.at)).tolist(), (pairs % len(b.at)).tolist()):
                found[d][2].update(b.items[k])
        out += found
        first = last
    return out


_KEPT: dict[str, Benchmark] = {}


def _benchmark(key: str, items, window: int) -> Benchmark:
    """Built once in each worker; one is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Benchmark(items.value, window)
    return _KEPT[key]


def _blocks(bench: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast item lists of at most BLOCK_BYTES of text each, unless one item alone is larger; and whether it is the last one."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).head()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n)) if n > 1 else F.lit(0)
    for k in range(n):
        yield bench.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in rows.filter(part == k).collect()]), k == n - 1


def overlaps(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, spans (array of first word and word after the last), items (sorted ids as strings)."""
    new = {"n_words", "n_hit", "spans", "items"}
    rows, names = own_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], F.col(f"`{text_col}`").alias(_free(docs))))
    *kept, text = names.items()
    key = scratch(docs.sparkSession, "benchmark")
    for k, (block, last) in enumerate(_blocks(bench, item_col, bench_col)):
        first, more = _scanners(block, f"{key}/{k}", window)
        rows = append_columns(rows, [text[1], "spans", "items"], more, FIELDS) if k else append_columns(rows, [text[1]], first, FIELDS)
        if not last:
            rows = written(rows, "overlaps")
            block.destroy()
    return rows.select(*[F.col(i).alias(c) for c, i in kept], "n_words", "n_hit", "spans", "items")


def _free(df: DataFrame) -> str:
    """A name that no column of df has."""
    return "_" * (1 + max((len(c) for c in df.columns), default=0))


FIELDS = "n_words bigint, n_hit bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"


def _scanners(block, key: str, window: int):
    """Column functions that scan texts for one block of the benchmark; the second adds to what other blocks gave."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def found(texts: pa.Array, before: list[tuple[list, list]] | None) -> pa.Array:
        b = _benchmark(key, block, window)
        n, spans, items = [], [], []
        for i, (size, runs, owners) in enumerate(scan(texts.to_pylist(), b)):
            old_runs, old_items = before[i] if before else ([], [])
            n.append(size)
            spans.append(_merged([*((s["first"], s["end"]) for s in old_runs), *runs]))
            items.append(sorted([*old_items, *(b.names[o] for o in owners)]))
        hit = pa.array([sum(z - a for a, z in s) for s in spans], pa.int64())
        places = pa.array([[{"first": a, "end": z} for a, z in s] for s in spans], kind)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), hit, places, pa.array(items, pa.list_(pa.string()))], ["n_words", "n_hit", "spans", "items"])

    def first(texts: pa.Array) -> pa.Array:
        return found(texts, None)

    def more(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        return found(texts, list(zip(spans.to_pylist(), items.to_pylist())))

    return first, more


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_col: str = "text") -> DataFrame:
    """For each item suffix (item, first) the longest verbatim match in all documents, of at least the shortest window, and one
    location: size in words, doc (the id as a string) and word. Suffixes without a match are left out."""
    schema = "item string, first bigint, size bigint, doc string, word bigint"
    found = None
    key = scratch(docs.sparkSession, "benchmark")
    best = F.max_by(F.struct("size", "doc", "word"), F.struct("size", "doc", "word")).alias("m")
    for k, (block, last) in enumerate(_blocks(bench, item_col, bench_col)):

        def run(batches, block=block, key=f"{key}/longest/{k}"):
            b = _benchmark(key, block, window)
            ends = np.nonzero(b.words < 0)[0]
            kind = pa.schema([("item", pa.string()), ("first", pa.int64()), ("size", pa.int64()), ("doc", pa.string()), ("word", pa.int64())])
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                shard = Shard(np.array([i for t in texts for i in [*(b.vocabulary.get(w, -1) for w in t), -1]], np.int32), b.depth, b.shortest)
                sizes, places = shard.longest(b)
                own = np.nonzero(sizes >= b.shortest)[0]
                item, doc = np.searchsorted(ends, b.suffixes[own]), np.searchsorted(at, places[own], "right") - 1
                first = b.suffixes[own] - np.where(item > 0, ends[item - 1] + 1, 0)
                columns = [[b.names[i] for i in item.tolist()], first, sizes[own], [names[d] for d in doc.tolist()], places[own] - at[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        part = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, schema)
        part = part.groupBy("item", "first").agg(best).select("item", "first", "m.size", "m.doc", "m.word")
        if not last:
            part = written(part, "longest")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("item", "first").agg(best).select("item", "first", "m.size", "m.doc", "m.word")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text") -> DataFrame:
    """docs without those that hold a window of the benchmark; all their columns as they were, whatever their names."""
    rows, names = own_names(docs)
    found = overlaps(rows, bench, window, names[text_col], item_col, bench_col).filter("n_hit = 0")
    return found.select(*[F.col(i).alias(c) for c, i in names.items()])
