"""Language-model scoring by prediction by partial matching (operator 7).

A text is seen as its words (A-Z in lower case, runs of other than white space) with one space between them and an end. The
model is a trie of byte contexts of up to ORDER bytes: at the longest known context a byte is coded by its count there, or an
escape leads to the next shorter context. Escapes are estimated by the number of different bytes seen (method C), bytes seen
in a longer context are excluded in shorter ones (full symbol exclusion), and counts of shorter contexts are those of update
exclusion: in how many longer contexts a byte was seen. What no context knows is coded evenly over the remaining bytes.

The trie is pretrained and kept whole, as one table for each depth: all (ORDER + 1)-grams of all training texts with their counts,
and for each shorter length the grams that end them. It grows with the corpus and nothing is cut from it. Since it is fixed when texts
are scored, a byte's code length hangs on the (ORDER + 1)-gram that it ends and on nothing else; so code lengths are worked out in
tables, once for each gram that is asked for: known grams from their context's counts, others down the escapes of their contexts.

The code lengths of the SENT most frequent grams (a bound of what is sent, not of the model) go to the executors, which add them
up; grams that a text has beside these meet their code lengths in a join. Contexts have at most 256 bytes after them, so no
group of the trie is hot; grams that very many texts ask for are broadcast, below a bound (common.spread_join).

The unigram baseline needs each word's count. Words are counted over all training texts in the same way. The FREQUENT most
frequent ones of at most WORD_BYTES are sent to the executors; all other words of documents meet their counts in a join.

Results: null and empty texts are one end. Rows are scored each by itself, repeated ones alike. Without training texts N and V
are 0, base_score is 0 and every byte costs log10(256). Columns of the input with the name of a new column are replaced. A long text
is handled in pieces of BYTES_AT_ONCE.

A worker holds, beside the rows it was given, the words of about BYTES_AT_ONCE of texts (or of one longer text) and at most about WORDS_AT_ONCE
words or GRAMS_AT_ONCE grams or what was sent, whatever its task has to read. Counts that were passed on early are added up in the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, scratch, smaller_batches, spread_join, written

ORDER = 5
#: Grams whose code lengths are sent to executors, and words whose counts are (and these words' bytes at most).
SENT = 1_000_000
FREQUENT = 131_072
WORD_BYTES = 64
#: Bytes handled at once.
BYTES_AT_ONCE = 1 << 18
#: Grams and their counts, and different words, that a task keeps before it passes them on.
GRAMS_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 1 << 17
#: Characters of texts whose words are counted before they are passed on, since words can be long.
TEXT_AT_ONCE = 1 << 24
#: Keys put into a table at once.
KEYS_AT_ONCE = 1 << 16
END = "\n"
#: What precedes a text as context; white space is in no word, so neither it nor the end is taken for text.
START = b"\n" * ORDER


def tokens(text: str | None) -> list[bytes]:
    """Words and the end."""
    return [*(text.encode().lower().split() if text else []), b"\n"]


def cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of texts of about BYTES_AT_ONCE begin and end."""
    first, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        size += n or 0
        if size >= BYTES_AT_ONCE:
            yield first, k
            first, size = k, 0
    if first < len(texts):
        yield first, len(texts)


def codes(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed (ORDER + 1)-grams that end in a text's own byte, with the text's place, in pieces of about BYTES_AT_ONCE."""
    first = 0
    while first < len(texts):
        runs, size, last = [], 0, first
        while last < len(texts) and (last == first or size < BYTES_AT_ONCE):
            runs.append(START + b" ".join(texts[last][:-1]) + b"\n")
            size += len(runs[-1])
            last += 1
        raw = np.frombuffer(b"".join(runs), np.uint8)
        ends = np.cumsum([len(r) for r in runs])
        starts = ends - [len(r) for r in runs]
        for a in range(ORDER, len(raw), BYTES_AT_ONCE):
            z = min(a + BYTES_AT_ONCE, len(raw))
            code = np.zeros(z - a, np.int64)
            for k in range(ORDER, -1, -1):
                code = code << 8 | raw[a - k : z - k]
            owner = np.repeat(np.arange(len(runs)), np.diff(np.clip(ends, a, z), prepend=a))
            own = np.arange(a, z) - starts[owner] >= ORDER
            yield code[own], owner[own] + first
        first = last


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in found)])
    n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(n) else n


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of all texts and their counts."""
    return _merged([np.unique(c, return_counts=True) for c, _ in codes(texts)])


class Hashed:
    """Values by key in an open hash table; a key and its value lie side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = int(2 * len(keys) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = np.full((1 << bits, 2), -1, np.int64)
        raw = np.ascontiguousarray(values, np.float64).view(np.int64)
        for a in range(0, len(keys), KEYS_AT_ONCE):
            todo, slot = np.arange(a, min(a + KEYS_AT_ONCE, len(keys))), self._slot(keys[a : a + KEYS_AT_ONCE])
            while len(todo):
                free = np.nonzero(self.rows[slot, 0] < 0)[0]
                _, first = np.unique(slot[free], return_index=True)
                put = free[first]
                self.rows[slot[put], 0], self.rows[slot[put], 1] = keys[todo[put]], raw[todo[put]]
                rest = np.ones(len(todo), bool)
                rest[put] = False
                todo, slot = todo[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h >>= self.shift
        return h.view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys (a contiguous array); nan for those that aren't there."""
        slot = self._slot(keys)
        rows = self.rows.take(slot, axis=0)
        out = np.ascontiguousarray(rows[:, 1]).view(np.float64)
        todo = np.nonzero(rows[:, 0] != keys)[0]
        out[todo] = np.nan
        held = rows[todo, 0] >= 0
        todo, slot = todo[held], slot[todo[held]]
        while len(todo):
            slot = slot + 1 & self.mask
            rows = self.rows.take(slot, axis=0)
            same = rows[:, 0] == keys[todo]
            out[todo[same]] = np.ascontiguousarray(rows[same, 1]).view(np.float64)
            more = ~same & (rows[:, 0] >= 0)
            todo, slot = todo[more], slot[more]
        return out


_KEPT: dict[str, tuple[Hashed, dict[bytes, float]]] = {}


def _sent(key: str, sent) -> tuple[Hashed, dict[bytes, float]]:
    if key not in _KEPT:
        _forget()
        keys, lengths, words, logs = sent.value
        _KEPT[key] = Hashed(keys, lengths), dict(zip(words, logs.tolist()))
    return _KEPT[key]


def _forget() -> None:
    """Frees what an earlier model left in this worker."""
    _KEPT.clear()
    give_back()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (the word's bytes) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())
            c.clear()
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([keys[k : k + 100_000], counts[k : k + 100_000]], ["key", "n"])

        _forget()
        c: Counter[bytes] = Counter()
        size = 0
        for b in batches:
            for t in b.column(0):
                c.update(tokens(t.as_py()))
                size += len(t.as_py() or "")
                if len(c) > WORDS_AT_ONCE or size > TEXT_AT_ONCE:
                    yield from out()
                    size = 0
        yield from out()
        give_back()

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (a packed (ORDER + 1)-gram) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(found)
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["key", "n"])

        _forget()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for first, last in cuts(b.column(0)):
                for code, _ in codes([tokens(t) for t in b.column(0)[first:last].to_pylist()]):
                    found.append(np.unique(code, return_counts=True))
                    if sum(len(c) for c, _ in found) > GRAMS_AT_ONCE:
                        found = [_merged(found)]
                        if len(found[0][0]) > GRAMS_AT_ONCE * 3 // 4:
                            yield from out(found)
                            found = []
        yield from out(found)
        found.clear()
        give_back()

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _tail(key: Column, size: int) -> Column:
    """The last bytes of a packed gram."""
    return key.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _context(key: Column) -> Column:
    """A packed gram without its last byte."""
    return F.shiftright(key, 8)


def trie(counts: DataFrame) -> list[DataFrame]:
    """The nodes of depth k at place k (place 0 is empty): key, a packed k-gram, and n, how often it was seen (the longest) or in how many contexts one byte longer."""
    nodes = [None] * (ORDER + 1) + [counts]
    for k in range(ORDER, 0, -1):
        nodes[k] = written(nodes[k + 1].groupBy(_tail(F.col("key"), k).alias("key")).agg(F.count("*").alias("n")), f"nodes-{k}")
    return nodes


def contexts(nodes: list[DataFrame]) -> tuple[tuple[int, int], list[DataFrame]]:
    """n and d of the empty context, and the contexts of k bytes at place k: context; n and d, the counts and the number of bytes seen
    after it; and next_n and next_d, the same at its end of k - 1 bytes without the bytes that were seen after the context itself."""
    root = tuple(nodes[1].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head())
    out: list[DataFrame] = [None]
    for k in range(1, ORDER + 1):
        shorter = nodes[k].select(F.col("key").alias("end"), F.col("n").alias("m"))
        seen = nodes[k + 1].withColumn("end", _tail(F.col("key"), k)).join(shorter, "end")
        own = seen.groupBy(_context(F.col("key")).alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.sum("m").alias("mass"))
        if k == 1:
            both = own.select("*", F.lit(root[0]).alias("up_n"), F.lit(root[1]).alias("up_d"))
        else:
            up = out[k - 1].select(F.col("context").alias("end"), F.col("n").alias("up_n"), F.col("d").alias("up_d"))
            both = own.withColumn("end", _tail(F.col("context"), k - 1)).join(F.broadcast(up) if k == 2 else up, "end")
        out.append(written(both.select("context", "n", "d", (F.col("up_n") - F.col("mass")).alias("next_n"), (F.col("up_d") - F.col("d")).alias("next_d")), f"contexts-{k}"))
    return root, out


def known_lengths(counts: DataFrame) -> DataFrame:
    """counts with value, the log10 of the probability of each gram's last byte. At most 256 grams share a context."""
    same = Window.partitionBy("context")
    rows = counts.withColumn("context", _context(F.col("key")))
    return rows.withColumn("value", F.log10(F.col("n") / (F.sum("n").over(same) + F.count("*").over(same)))).drop("context")


def unknown_lengths(asked: DataFrame, nodes: list[DataFrame], root: tuple[int, int], after: list[DataFrame]) -> DataFrame:
    """asked (key: grams that no training text has) with value: down the escapes of their contexts.

    Contexts of one byte and grams of up to two are at most 65,536, so they are broadcast.
    """
    none = F.lit(None).cast("double")
    rows = asked.select("*", F.lit(0.0).alias("value"), none.alias("found"), F.lit(False).alias("wide"), none.alias("next_n"), none.alias("next_d"))
    for k in range(ORDER, -1, -1):
        if k:
            here = after[k].select(F.col("context").alias("at"), F.col("n").alias("own_n"), F.col("d").alias("own_d"), F.col("next_n").alias("then_n"), F.col("next_d").alias("then_d"))
            rows = rows.withColumn("at", _tail(_context(F.col("key")), k)).join(F.broadcast(here) if k == 1 else here, "at", "left")
        else:
            own = F.lit(root[0]) if root[1] else F.lit(None).cast("bigint")
            rows = rows.select("*", own.alias("own_n"), F.lit(root[1]).alias("own_d"), none.alias("then_n"), none.alias("then_d"))
        if k < ORDER:
            seen = nodes[k + 1].select(F.col("key").alias("gram"), F.col("n").alias("count"))
            rows = rows.withColumn("gram", _tail(F.col("key"), k + 1)).join(F.broadcast(seen) if k <= 1 else seen, "gram", "left")
        else:
            rows = rows.withColumn("count", none)
        n, d = F.when(F.col("wide"), F.col("next_n")).otherwise(F.col("own_n")), F.when(F.col("wide"), F.col("next_d")).otherwise(F.col("own_d"))
        open_, known = F.col("found").isNull(), F.col("own_n").isNotNull()
        rows = rows.select(
            *asked.columns,
            F.when(open_ & F.col("count").isNull() & known & (d > 0), F.col("value") + F.log10(d / (n + d))).otherwise(F.col("value")).alias("value"),
            F.when(open_ & F.col("count").isNotNull() & known, F.log10(F.col("count") / (n + d))).otherwise(F.col("found")).alias("found"),
            (F.col("wide") | known).alias("wide"),
            F.col("then_n").cast("double").alias("next_n"),
            F.col("then_d").cast("double").alias("next_d"),
        )
    rest = F.lit(-float(np.log10(256 - root[1])) if root[1] < 256 else 0.0)
    return rows.select(*asked.columns, (F.col("value") + F.coalesce("found", rest)).alias("value"))


def _most(counts: DataFrame, most: int) -> Column:
    """Which rows are the `most` ones of the largest counts; where counts tie, a hash decides. The driver gets a histogram only."""
    mark = F.floor(F.log2("n") * 16).cast("int")
    total = 0
    for r in sorted(counts.groupBy(mark.alias("mark")).count().collect(), key=lambda r: -r.mark):
        if total + r["count"] > most:
            share = int((most - total) / r["count"] * (1 << 20) * 0.99)
            return (mark > r.mark) | ((mark == r.mark) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share))
        total += r["count"]
    return F.lit(True)


def score(docs: DataFrame, train: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, learned from train."""
    spark = docs.sparkSession
    with smaller_batches(spark):
        words = written(word_counts(train, text_col), "word-counts")
        counts = written(known_lengths(gram_counts(train, text_col)), "grams")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    often = counts.where(_most(counts, SENT)).select("key", "value").toArrow()
    short = F.octet_length("key") <= WORD_BYTES
    frequent = short & _most(words.where(short), FREQUENT)
    told = words.where(frequent).toArrow()
    logs = np.log10(told.column("n").to_numpy() + 1)
    sent = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("value").to_numpy(), told.column("key").to_pylist(), logs))
    key = scratch(spark, "model")
    new = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, names)], F.col(f"`{text_col}`").alias("__text"))
    inner = [T.StructField(c, f.dataType, True) for f, c in zip(kept, names)]
    extra = T._parse_datatype_string("row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word: binary, n: bigint>>, grams array<struct<gram: bigint, n: bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, log = _sent(key, sent)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for first, last in cuts(whole.column(whole.num_columns - 1)):
                b = whole.slice(first, last - first)
                texts = [tokens(t) for t in b.column(b.num_columns - 1).to_pylist()]
                sizes, known, base, rare = [], [], [], []
                for t in texts:
                    found = list(map(log.get, t))
                    if None in found:
                        rare.append([{"word": w, "n": n} for w, n in Counter(w for w, x in zip(t, found) if x is None).items()])
                        found = [x for x in found if x is not None]
                    else:
                        rare.append([])
                    sizes.append(len(t))
                    known.append(len(found))
                    base.append(float(sum(found)))
                ids = pa.array(range(row, row + len(texts)), pa.int64())
                bits, others = _code_lengths(texts, lengths)
                arrays = [ids, pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(bits), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), others]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*names, *(f.name for f in extra.fields)])
        give_back()

    with smaller_batches(spark):
        scored = written(rows.mapInArrow(run, T.StructType([*inner, *extra.fields])), "scored")
    sent.destroy()
    each = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("key"), F.col("r.n").alias("times"))
    by_word = each.join(words.where(~frequent), "key").select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.lit(0.0).alias("bits"))
    missing = scored.select("row", F.explode("grams").alias("g")).select("row", F.col("g.gram").alias("key"), F.col("g.n").alias("times"))
    by_gram = spread_join(missing, _asked(missing, counts), "key", "rows").select("row", F.lit(0).cast("bigint").alias("more"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("value")).alias("bits"))
    found = by_word.unionByName(by_gram).groupBy("row").agg(F.sum("more").alias("more"), F.sum("gain").alias("gain"), F.sum("bits").alias("bits"))
    joined = scored.drop("rare", "grams").join(found, "row", "left")
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + kinds + 1))
    return joined.select(
        *[F.col(c).alias(f.name) for f, c in zip(kept, names)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("bits", F.lit(0.0))).alias("score"),
    )


def _code_lengths(texts: list[list[bytes]], lengths: Hashed) -> tuple[np.ndarray, pa.Array]:
    """The sum of each text's log10 probabilities that were sent, and its other grams with how often it has them."""
    out, others = np.zeros(len(texts)), []
    for code, owner in codes(texts):
        value = lengths.get(code)
        miss = np.isnan(value)
        value[miss] = 0
        out += np.bincount(owner, value, len(texts))
        others.append(np.unique(np.stack([owner[miss], code[miss]]), axis=1, return_counts=True))
    owner, code = np.concatenate([x for x, _ in others], axis=1) if others else np.zeros((2, 0), np.int64)
    n = np.concatenate([n for _, n in others]) if others else np.zeros(0, np.int64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    pairs = pa.StructArray.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["gram", "n"])
    return out, pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pairs)


def _asked(missing: DataFrame, counts: DataFrame) -> DataFrame:
    """key, rows (how many ask for it) and value of each gram that is missing in some text."""
    asked = missing.groupBy("key").agg(F.count("*").alias("rows"))
    asked = written(asked.join(counts.select("key", "value"), "key", "left"), "asked")
    have, others = asked.where("value is not null"), asked.where("value is null").drop("value")
    if others.isEmpty():
        return have
    nodes = trie(counts.select("key", "n"))
    return written(have.unionByName(unknown_lengths(others, nodes, *contexts(nodes))), "asked-lengths")
