"""Line dedup by segment-partition edit join (operator 4), in DataFrame functions only.

A line goes if the same line came earlier in the corpus, or if a line came earlier that is only a few edits of bytes away: one edit
for each BYTES_PER_EDIT bytes of the shorter line, DISTANCE at most. So a line of fewer bytes goes only if it is the same.
Lines come in the order of document id, then line number. Blank lines stay.

The edit join is over distinct lines. Each is cut into one more even segments than it may have edits: within the distance, one
segment at least is left whole, and only a few places can hold it. So each line is indexed by its segments (with number and the line's length
in the key), and probes, for each length up to its own, the substrings that a match could leave there (multi-match-aware
selection). Pairs that share a key are compared by counts of a few bytes first, in the join itself, so it puts out few pairs
where many lines share a segment. Keys that more than HOT_LINES lines have are dealt: their lines are cut in chunks by a hash, and
each pair of chunks is a key of its own, so no key's comparisons are one task's. A banded bit-parallel edit distance (vertical deltas of the band in one word) decides.

Only keys, hashes and counts are shuffled for the join; texts are shuffled once, pre-aggregated, to find distinct lines.
Decisions are joined back by a 128-bit hash of the line.

Results: null texts have no lines and stay null. An empty text is one blank line. Rows with equal id and text are one
document for what came earlier and are all treated alike; rows with equal ids and different texts are ordered by a hash of
the text. Null ids come first. Other columns are kept as they are, but for those with the name of a new one. Long lines are compared
whole: the distance's cost is in proportion to their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, own_names, written

DISTANCE = 2
BYTES_PER_EDIT = 20
#: Lines of one key, beyond which they are compared in chunks of about so many, and keys of which that is told at most.
HOT_LINES = 4096
#: Ids of candidate lines that are sent to all executors; more of them are joined by a shuffle.
SENT_IDS = 1_000_000
#: Characters that are counted, modulo 16, for the comparison in the join; frequent ones first.
COUNTED = " etnraoishldcumf"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    """Whether the edit distance of two binary columns, of at least 2 * distance + 1 bytes each, is within distance.

    Hyyro's bit-parallel algorithm on a band of 2 * distance + 1 diagonals: bit t of a word is row j - distance + t of
    column j. The distance is followed down the lowest diagonal to the last row, then along that row.
    """
    k, width = distance, 2 * distance + 1
    full, top = (1 << width) - 1, 1 << 2 * distance
    m, n = F.octet_length(a).cast("int"), F.octet_length(b).cast("int")
    # a's bytes with `distance` empty places before and after them
    codes = lambda x, size: F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(x, i, F.lit(1)))
    none = F.array(*[F.lit(b"")] * k)

    def masks(rows: Column, columns: Column) -> Column:
        return F.transform(
            columns,
            lambda c, j: sum((F.when(F.get(rows, j + t) == c, F.lit(1 << t)).otherwise(F.lit(0)) for t in range(1, width)), F.when(F.get(rows, j) == c, F.lit(1)).otherwise(F.lit(0))),
        )

    def step(state: Column, x: Column, size: Column) -> Column:
        vp, vn, d, j = (state.getField(f) for f in ("vp", "vn", "d", "j"))
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def rest(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(full))
            hn = d0.bitwiseAND(vp)
            low = F.shiftright(d0, 1)
            row = F.lit(2 * k) - (j - (size - k))  # bit of the last row, once the lowest diagonal has left it
            along = F.when(F.getbit(hp, row) == 1, F.lit(1)).otherwise(F.lit(0)) - F.when(F.getbit(hn, row) == 1, F.lit(1)).otherwise(F.lit(0))
            down = F.when(d0.bitwiseAND(F.lit(top)) == 0, F.lit(1)).otherwise(F.lit(0))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
                low.bitwiseAND(hp).alias("vn"),
                (d + F.when(j <= size - k, down).otherwise(along)).alias("d"),
                (j + 1).alias("j"),
            )

        return _let(d0, rest)

    start = F.struct(F.lit(full >> k << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"), F.lit(1).alias("j"))
    rows = F.concat(none, codes(a, m), none)
    x = _let(rows, lambda r: masks(r, codes(b, n)))
    found = F.aggregate(x, start, lambda s, v: step(s, v, m), lambda s: s.getField("d") <= distance)
    return F.when(F.abs(m - n) > distance, F.lit(False)).when(a == b, F.lit(True)).when(~plausible(a, b, k), F.lit(False)).otherwise(found)


def _common(a: Column, b: Column, most: Column, back: bool) -> Column:
    """Bytes that two binary columns have in common at the start (or, back, at the end), at most `most`, by halving steps."""
    m, n = F.octet_length(a), F.octet_length(b)

    def longer(p: Column, step: Column) -> Column:
        x, y = (m - p - step + 1, n - p - step + 1) if back else (p + 1, p + 1)
        return F.when(p + step > most, p).when(F.substring(a, x.cast("int"), step) == F.substring(b, y.cast("int"), step), p + step).otherwise(p)

    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    return F.aggregate(steps, F.lit(0), longer)


def plausible(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    """False only for binary columns that are over distance apart.

    Without what they share at both ends, an edit is at the start and one at the end. The others, distance - 2 at most, leave one
    of distance - 1 pieces in between whole, in a place that is distance off at most.
    """
    least = F.least(F.octet_length(a), F.octet_length(b))

    def middle(t: Column) -> Column:
        head, tail = t.getField("head"), t.getField("tail")
        size = F.octet_length(a) - head - tail - 2
        parts = max(1, distance - 1)
        whole = F.lit(False)
        for i in range(parts):
            start, length = _segment(size, i, parts)
            at = head + 1 + start + 1
            piece = F.substring(a, at.cast("int"), length)
            for shift in range(-distance, distance + 1):
                whole = whole | ((at + shift >= 1) & (piece == F.substring(b, F.greatest(at + shift, F.lit(1)).cast("int"), length)))
        return F.when(size < 2 * parts, F.lit(True)).otherwise(whole)

    ends = lambda head: F.struct(head.alias("head"), _common(a, b, least - head, True).alias("tail"))
    return _let(_let(_common(a, b, least, False), ends), middle)


def _segment(size: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of this size.

    Never null, in integers, and without sums for the ends: Spark puts all keys of a line in one method, which the JVM leaves uncompiled if it is long.
    """
    bound = lambda k: F.lit(0) if k == 0 else size if k == parts else F.coalesce(F.call_function("div", size * k if k > 1 else size, F.lit(parts)).cast("int"), F.lit(0))
    start = bound(i)
    return start, (bound(i + 1) - start if i else bound(1))


def _key(i: int, indexed: Column, text: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(indexed * 64 + i, F.substring(text, start + 1, size))


def _allows(size: Column, edits: int, distance: int, per_edit: int) -> Column:
    """Whether a line of this size may have so many edits, and no more."""
    least = size >= per_edit * edits
    return least if edits == distance else least & (size < per_edit * (edits + 1))


def index_keys(text: Column, size: Column, distance: int = DISTANCE, per_edit: int = BYTES_PER_EDIT) -> Column:
    keys = F.array().cast("array<bigint>")
    for edits in range(1, distance + 1):
        own = F.array(*[_key(i, size, text, *_segment(size, i, edits + 1)) for i in range(edits + 1)])
        keys = F.when(_allows(size, edits, distance, per_edit), own).otherwise(keys)
    return keys


def probe_keys(text: Column, size: Column, distance: int = DISTANCE, per_edit: int = BYTES_PER_EDIT) -> Column:
    """Keys of all substrings that can be a segment of a line that is shorter or as long and within distance."""
    none, found = F.array().cast("array<bigint>"), []
    for edits in range(1, distance + 1):
        for shorter in range(edits + 1):
            indexed, keys = (size - shorter if shorter else size), []
            for i in range(edits + 1):
                start, length = _segment(indexed, i, edits + 1)
                rest = edits - i
                for shift in range(max(-i, shorter - rest), min(i, shorter + rest) + 1):
                    keys.append(_key(i, indexed, text, start + shift if shift else start, length))
            found.append(F.when(_allows(indexed, edits, distance, per_edit), F.array(*keys)).otherwise(none))
    return F.concat(*found)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, hash (of its text), line (from 0), text (a line)."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.split(text_col, "\n").alias("all"))
    return rows.select("doc", "hash", F.posexplode("all").alias("line", "text"))


def _ids(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line that isn't blank, once: text, n (occurrences), first (doc, hash, line).

    Grouping sorts, as structs have no place in a hash table: by a hash first, since many lines start alike.
    """
    found = lines(docs, id_col, text_col).where(F.trim("text") != "").withColumn("h", F.xxhash64("text"))
    return found.groupBy("h", "text").agg(F.count("*").alias("n"), F.min(F.struct("doc", "hash", "line")).alias("first")).drop("h")


def counted(distinct: DataFrame) -> DataFrame:
    """distinct with the counts of COUNTED characters in each line, four bits each. Each is searched in what the ones before it leave of the line."""
    counts, rest = F.lit(0).cast("bigint"), F.col("text")
    for i, c in enumerate(COUNTED):
        left = F.replace(rest, F.lit(c), F.lit(""))
        n = (F.octet_length(rest) - F.octet_length(left)).bitwiseAND(F.lit(15)).cast("bigint")
        counts, rest = counts.bitwiseOR(F.shiftleft(n, 4 * i)), left
    return distinct.withColumn("counts", counts)


def _dealt(index: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """index and probe with what else than the key must be equal: for hot keys, a pair of chunks."""
    counts = written(index.groupBy("key").count().where(F.col("count") > HOT_LINES), "line-keys")
    if counts.isEmpty():
        return index, probe, []
    border = max(HOT_LINES, index.count() // HOT_KEYS)  # so that no more than HOT_KEYS are told
    hot = F.broadcast(counts.where(F.col("count") > border).select("key", F.ceil(F.col("count") / HOT_LINES).alias("chunks")))

    def cut(rows: DataFrame, own: str, other: str) -> DataFrame:
        chunks = F.coalesce("chunks", F.lit(1))
        rows = rows.join(hot, "key", "left").withColumn(own, F.pmod(F.xxhash64("id", F.lit(3)), chunks))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))).drop("chunks")

    return cut(index, "i", "j"), cut(probe, "j", "i"), ["i", "j"]


def links(distinct: DataFrame, distance: int = DISTANCE, per_edit: int = BYTES_PER_EDIT) -> DataFrame:
    """Pairs of different lines (of counted()) within distance: a and b, each a struct of text, n and first; each pair once."""
    long = distinct.where(F.octet_length("text") >= per_edit)
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    entry = long.select(F.xxhash64("text").alias("id"), "counts", size.alias("size"), data.alias("data"))
    index = entry.select("id", F.explode(index_keys(F.col("data"), F.col("size"), distance, per_edit)).alias("key"), "counts")
    probe = entry.select("id", F.explode(probe_keys(F.col("data"), F.col("size"), distance, per_edit)).alias("key"), "counts")
    index, probe, also = _dealt(index, probe)

    def apart(i: int) -> Column:
        one = lambda t: F.shiftrightunsigned(F.col(f"{t}.counts"), 4 * i).bitwiseAND(F.lit(15))
        d = F.abs(one("x") - one("y"))
        return F.least(d, F.lit(16) - d)  # counts are known up to multiples of 16

    near = sum((apart(i) for i in range(1, len(COUNTED))), apart(0)) <= 2 * distance  # an edit changes two counts by one
    same = (F.col("x.id") != F.col("y.id")) & near
    for c in ["key", *also]:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    met = index.alias("x").join(probe.alias("y"), same)
    pairs = written(met.select(F.least("x.id", "y.id").alias("i"), F.greatest("x.id", "y.id").alias("j")).distinct(), "line-candidates")
    ids = pairs.select(F.col("i").alias("id")).union(pairs.select(F.col("j").alias("id"))).distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = long.withColumn("id", F.xxhash64("text")).join(ids, "id", "left_semi")
    texts = written(texts.select("id", F.struct("text", "n", "first").alias("of")), "line-texts")
    both = pairs.join(texts.select(F.col("id").alias("i"), F.col("of").alias("a")), "i").join(texts.select(F.col("id").alias("j"), F.col("of").alias("b")), "j")
    longer = lambda t, u: F.when(F.octet_length("a.text") >= F.octet_length("b.text"), F.encode(t, "UTF-8")).otherwise(F.encode(u, "UTF-8"))
    shorter, close = F.least(F.octet_length("a.text"), F.octet_length("b.text")), F.lit(False)
    for edits in range(1, distance + 1):
        close = F.when(_allows(shorter, edits, distance, per_edit), within(longer("a.text", "b.text"), longer("b.text", "a.text"), edits)).otherwise(close)
    return both.where(close).select("a", "b")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, per_edit: int = BYTES_PER_EDIT) -> DataFrame:
    """Of each document with lines to drop: doc, hash, exact and near (sorted line numbers)."""
    distinct = written(counted(distinct_lines(docs, id_col, text_col)), "lines")
    linked = written(links(distinct, distance, per_edit), "line-links")
    ends = linked.select(F.col("a").alias("own"), F.col("b.first").alias("other")).unionByName(linked.select(F.col("b").alias("own"), F.col("a.first").alias("other")))
    late = ends.where(F.col("other") < F.col("own.first")).select(F.col("own.text").alias("text"), F.col("own.first").alias("first")).distinct()
    again = distinct.where("n > 1").select("text", "first")
    whole = lambda d, near: d.select(*_ids(F.col("text")), "first", F.lit(near).alias("near"))
    told = whole(again, False).unionByName(whole(late, True)).groupBy("h1", "h2", "first").agg(F.max("near").alias("near"))
    told = written(told, "line-decisions")
    every = lines(docs, id_col, text_col).select("doc", "hash", "line", *_ids(F.col("text")))
    first = F.struct("doc", "hash", "line") == F.col("first")
    found = every.join(told, ["h1", "h2"]).where(F.col("near") | ~F.coalesce(first, F.col("doc").isNull() & F.col("first.doc").isNull() & (F.col("hash") == F.col("first.hash")) & (F.col("line") == F.col("first.line"))))
    pick = lambda near: F.sort_array(F.collect_set(F.when(F.col("near") == near, F.col("line"))))
    return found.groupBy("doc", "hash").agg(pick(False).alias("exact"), pick(True).alias("near"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, per_edit: int = BYTES_PER_EDIT) -> DataFrame:
    """docs with text_col less its dropped lines, and n_lines, n_exact, n_near (lines dropped) as longs."""
    told = written(decisions(docs, id_col, text_col, distance, per_edit), "dropped-lines")
    told = told.select("doc", F.col("hash").alias("of"), "exact", "near")
    rows, names = own_names(docs)
    text = F.col(names[text_col])
    joined = rows.join(told, F.col(names[id_col]).eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("of")), "left")
    all_lines = F.split(text, "\n")
    # a text is split once, and the numbers of lines that stay are found by a hash table (array_except of integers), so no text's cost grows with the square of its lines
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.concat("exact", "near"))
    left = _let(all_lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    kept = {c: i for c, i in names.items() if c.lower() not in {"n_lines", "n_exact", "n_near"}}
    new = F.when(F.col("of").isNull(), text).otherwise(left)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return joined.select(
        *[(new if c == text_col else F.col(i)).alias(c) for c, i in kept.items()],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("bigint").alias("n_lines"),
        F.when(F.col("of").isNull(), F.lit(0)).otherwise(size("exact")).cast("bigint").alias("n_exact"),
        F.when(F.col("of").isNull(), F.lit(0)).otherwise(size("near")).cast("bigint").alias("n_near"),
    )
