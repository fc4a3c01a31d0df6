"""SimHash near-duplicates (operator 5) by bit-sliced comparison.

Fingerprints of 64 bits are linked at RADIUS or fewer differing bits. Distinct fingerprints are dealt by their equal pieces:
of four pieces of 16 bits, two at least are equal within the radius, so each pair of pieces is a bucket key. A bucket is
split by a hash into chunks of about CHUNK fingerprints and each pair of chunks is a task of its own, so no bucket lands in
one task. There, the bit planes of the fingerprints are stored vertically (one bit string for each of the 64 bits);
carry-save counters add the planes that differ from a query, for 64 fingerprints in a word, and a block is abandoned once
all of its counters are past the radius. A task gives a spanning forest of its links, not all pairs; components follow.

Results: A-Z in lower case; words [^\\x20\\x09-\\x0D]+; shingles of SHINGLE words, repeats included; with fewer words the whole
sequence is the shingle; null and texts without words have fingerprint zero, which links like any other. Equal texts share
a fingerprint. Repeated ids are one document for components; documents with a null id get their fingerprint, and the
smallest id that isn't null of their group (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, give_back, own_names, spread_join, written
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 2048
#: Fingerprints of a bit-sliced block.
BLOCK = 4096
#: Shingle hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 18


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    found = text.encode().lower().split() if text else []
    if len(found) <= size:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(size)))))


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    out, first = np.zeros(len(texts), np.uint64), 0
    while first < len(texts):
        hashes: list[int] = []
        ends, last = [], first
        while last < len(texts) and len(hashes) < HASHES_AT_ONCE:
            hashes += [xxh64_intdigest(s, SEED) for s in shingles(texts[last], size)]
            ends.append(len(hashes))
            last += 1
        out[first:last] = _majority(np.array(hashes, "<u8"), np.array(ends))
        first = last
    return out


def _majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = np.diff(ends, prepend=0)
    some = n > 0
    bits = np.zeros((len(ends), 64), np.int64)
    if some.any():
        starts = (ends - n)[some]
        for k in range(8):  # a byte of the hashes at a time, to bound memory
            flat = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8)[:, k : k + 1], axis=1, bitorder="little")
            bits[some, 8 * k : 8 * k + 8] = np.add.reduceat(flat, starts, axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


class Planes:
    """Fingerprints as bit planes: word w of plane i has bit i of fingerprints 64 * w and so on."""

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        padded = np.zeros(-(-self.n // 64) * 64, "<u8")
        padded[: self.n] = prints
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
        self.real = np.packbits(np.arange(len(padded)) < self.n, bitorder="little").view("<u8")

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) places at radius or fewer differing bits."""
        # Counters are bit-sliced too: ones, twos, ... for each (query, word); past says which have passed the radius.
        size = max(1, int(radius).bit_length())
        live = np.arange(len(queries))
        counters = [np.zeros((len(queries), self.planes.shape[1]), np.uint64) for _ in range(size)]
        past = np.broadcast_to(~self.real, counters[0].shape).copy()
        for i in range(64):
            flip = -(queries[live] >> np.uint64(i) & np.uint64(1)).astype(np.int64)
            carry = self.planes[i][None, :] ^ flip.view(np.uint64)[:, None]
            for c in counters:
                c ^= carry  # sum
                carry &= ~c  # carry: was 1 and got 1
            past |= carry  # over all counters
            if i >= radius:
                over = self._over(counters, radius)
                past |= over
                if i % 8 == 7:
                    open_ = ~(past == ~np.uint64(0)).all(1)
                    if not open_.any():
                        return np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if open_.mean() < 0.75:  # abandon the queries' blocks that are past the radius everywhere
                        live, past, counters = live[open_], past[open_], [c[open_] for c in counters]
        rows = np.unpackbits(np.ascontiguousarray(~past).view(np.uint8), axis=1, bitorder="little")
        q, f = np.nonzero(rows)
        return live[q], f

    @staticmethod
    def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """Where the counters are above the radius."""
        over, same = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                same = same & counters[k]
            else:
                over |= same & counters[k]
                same = same & ~counters[k]
        return over


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Edges that join what is linked between left and right (or within left): at most one for each fingerprint and block."""
    both = left if right is None else np.concatenate([left, right])
    root = np.arange(len(both))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    other, shift = (left, 0) if right is None else (right, len(left))
    for b in range(0, len(other), BLOCK):
        planes = Planes(other[b : b + BLOCK])
        for a in range(0, len(left), 512):
            q, f = planes.within(left[a : a + 512], radius)
            for x, y in zip((q + a).tolist(), (f + b + shift).tolist()):
                if x != y and (u := find(x)) != (v := find(y)):
                    root[max(u, v)] = min(u, v)
                    yield int(both[x]), int(both[y])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (column print) that connect all within radius."""
    if radius > 2:
        raise ValueError("four pieces find pairs within two bits")
    part = [F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for k, (i, j) in enumerate(pairs)])
    dealt = prints.select("print", F.explode(keys).alias("key"))
    sizes = written(dealt.groupBy("key").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / CHUNK)), "buckets")
    mine = F.pmod(F.xxhash64("print", F.lit(1)), F.col("chunks"))
    tasks = (
        spread_join(dealt, sizes, "key", "count")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "print")
    )

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        mine, found = group.column("mine").to_numpy(), group.column("print").to_numpy().view(np.uint64)
        order = np.argsort(found)
        mine, found = mine[order], found[order]
        edges = list(forest(found, None, radius) if i == j else forest(found[mine == i], found[mine == j], radius))
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    # rows are few for the work on them, so partitions aren't joined by their bytes
    n = max(prints.sparkSession.sparkContext.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tasks.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def fingerprinted(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with print, the fingerprint as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(fingerprints(texts.to_pylist(), shingle).view(np.int64))], ["print"])

    return append_columns(docs, [text_col], run, "print bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, print and component_id (the smallest id reachable by links) for each row of docs."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    marked = written(fingerprinted(ids, "__text", shingle).drop("__text"), "fingerprints")
    least = written(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    joined = components(links(least.select("print"), radius))
    named = least.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "component").select("print", "component_id")
    return marked.join(by_print, "print").select("doc_id", "print", "component_id")


# Near-duplicates by similarity ------------------------------------------------------------------------------------------
#
# At a Jaccard similarity of 0.8, fingerprints differ in about ten bits, and no pieces of 64 bits stay equal. Documents are
# then dealt by bands of minimum hashes of the same shingles; in a bucket the bit-sliced comparison at WIDE bits joins
# candidates to clusters. It reads one bit of each of 64 further minimum hashes: unlike majorities, they depend on the set of
# shingles only, and each differs with half of what two sets are apart, 0.1 at 0.8, whatever their size. In a cluster all texts are compared
# by the exact similarity of their sets of shingles: from each text on, what is similar is joined and followed in turn, and only
# what isn't joined yet is compared, so a cluster of copies takes one pass and each link that is given was checked.

SIMILARITY = 0.8
NEAR_SHINGLE = 5
WIDE = 17
BANDS, ROWS = 16, 4
BITS = 64
#: Buckets of up to so many fingerprints are compared pair by pair, many buckets in one bit-sliced pass.
SMALL = 16
#: Clusters of candidates are cut in chunks of about so many texts and shingles; each pair of chunks is a task.
CLUSTER = 2048
CLUSTER_SHINGLES = 1 << 19
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS + BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def node_of(hashes: np.ndarray) -> int:
    """What stands for a set of shingles, given by its ascending hashes."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def sketches(texts: list[str | None], size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text 64 one-bit minimum hashes, its bands' keys and the node of its set of shingles. Texts without words share them."""
    from xxhash import xxh64_intdigest

    least = np.zeros((BANDS * ROWS + BITS, len(texts)), np.uint32)
    nodes = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        hashes: list[int] = []
        ends, last = [], first
        while last < len(texts) and len(hashes) < HASHES_AT_ONCE:
            hashes += [xxh64_intdigest(s, SEED) for s in shingles(texts[last], size)]
            ends.append(len(hashes))
            last += 1
        h, e = np.array(hashes, "<u8"), np.array(ends)
        for k, (a, z) in enumerate(zip((e - np.diff(e, prepend=0)).tolist(), ends)):
            nodes[first + k] = node_of(np.unique(h[a:z]))
        some = np.diff(e, prepend=0) > 0
        if some.any():
            starts, own = (e - np.diff(e, prepend=0))[some], np.nonzero(some)[0] + first
            for k in range(len(least)):
                least[k, own] = np.minimum.reduceat((h * _MULTIPLY[k] >> np.uint64(32)).astype(np.uint32), starts)
        first = last
    prints = np.packbits(np.ascontiguousarray((least[BANDS * ROWS :] & 1).astype(np.uint8).T), axis=1, bitorder="little").view("<u8").ravel()
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(texts), b + 1, np.uint64)
        for r in range(ROWS):
            key = (key ^ least[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return prints, keys.view(np.int64), nodes


def sketched(docs: DataFrame, text_col: str = "text", shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs with print, bands and node."""

    def run(texts: pa.Array) -> pa.Array:
        prints, keys, nodes = sketches(texts.to_pylist(), shingle)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
        return pa.StructArray.from_arrays([pa.array(prints.view(np.int64)), lists, pa.array(nodes)], ["print", "bands", "node"])

    return append_columns(docs, [text_col], run, "print bigint, bands array<bigint>, node bigint")


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs left[i], right[i] differ in radius or fewer bits: 64 pairs in a word, counted with carry-save."""
    a, b = Planes(left), Planes(right)
    counters = [np.zeros(a.planes.shape[1], np.uint64) for _ in range(7)]
    for i in range(64):
        carry = a.planes[i] ^ b.planes[i]
        for c in counters:
            c ^= carry
            carry &= ~c
    far = Planes._over(counters, radius)
    return np.unpackbits((~far).view(np.uint8), bitorder="little")[: len(left)].astype(bool)


def _joined(nodes: np.ndarray, prints: np.ndarray, mine: np.ndarray, same: bool, radius: int) -> Iterator[np.ndarray]:
    """(a, b) rows that join all within the radius, in a chunk or between two: at most one for each fingerprint."""
    left = np.arange(len(nodes)) if same else np.nonzero(mine == mine.min())[0]
    right = left if same else np.nonzero(mine != mine.min())[0]
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    edges = []
    for b in range(0, len(right), BLOCK):
        planes = Planes(prints[right[b : b + BLOCK]])
        for a in range(0, len(left), 64):
            q, f = planes.within(prints[left[a : a + 64]], radius)
            x, y = left[q + a], right[f + b]
            apart = root[x] != root[y]
            for u, v in zip(x[apart].tolist(), y[apart].tolist()):
                if (i := find(u)) != (j := find(v)):
                    root[max(i, j)] = min(i, j)
                    edges.append((u, v))
            while (root != (up := root[root])).any():
                root = up
    if edges:
        yield nodes[np.array(edges)]


def _bucketed(radius: int):
    """mapInArrow over rows sorted by (key, i, j): one bucket's pair of chunks after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], ["a", "b"])

        def bucket(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for e in _joined(rows[:, 4], np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 3], rows[0, 1] == rows[0, 2], radius):
                if len(e):
                    yield out(e)

        rest = np.zeros((0, 6), np.int64)
        for b in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in b.columns], 1)])
            cuts = np.nonzero((np.diff(rows[:, :3], axis=0) != 0).any(1))[0] + 1
            if not len(cuts):
                rest = rows
                continue
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(starts)  # the last bucket may go on in the next batch
            yield from _small(rows, starts[:-1][sizes <= SMALL], sizes[sizes <= SMALL], radius, out)
            for k in np.nonzero(sizes > SMALL)[0].tolist():
                yield from bucket(rows[starts[k] : starts[k + 1]])
            rest = rows[cuts[-1] :]
        if len(rest):
            yield from bucket(rest)

    return run


def _small(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, out) -> Iterator[pa.RecordBatch]:
    left, right = [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    if left:
        x, y = rows[np.concatenate(left)], rows[np.concatenate(right)]
        meet = (x[:, 1] == x[:, 2]) | (x[:, 3] != y[:, 3])  # between two chunks, pairs of one chunk are another task's
        near = pairs_within(np.ascontiguousarray(x[:, 5]).view(np.uint64), np.ascontiguousarray(y[:, 5]).view(np.uint64), radius) & meet & (x[:, 4] != y[:, 4])
        yield out(np.stack([x[near, 4], y[near, 4]], 1))


def distinct_shingles(text: str | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """The ascending hashes of a text's different shingles."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in set(shingles(text, size))], "<u8"))


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) that join all sets linked by a Jaccard similarity of at least this; each of them has it."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(sizes))
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    order = np.argsort(-sizes, kind="stable")
    rest = order[sizes[order] > 0].astype(np.int64)  # not joined yet; sets without members are like no other
    flat, starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    live, held = np.zeros(0, bool), np.zeros(0, np.int64)

    def hold() -> None:
        nonlocal flat, starts, live, held
        held, live = rest, np.ones(len(rest), bool)
        flat = np.concatenate([ids[at[i] : at[i + 1]] for i in rest.tolist()]) if len(rest) else flat[:0]
        starts = np.cumsum(sizes[rest]) - sizes[rest]

    edges: list[tuple[int, int]] = []
    hold()
    place = 0
    while place < len(held):
        if not live[place]:
            place += 1
            continue
        live[place] = False
        open_ = [int(held[place])]
        while open_ and live.any():
            p = open_.pop()
            own = ids[at[p] : at[p + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            near = np.nonzero(live & (shared / (sizes[held] + sizes[p] - shared) >= similarity))[0]
            live[near] = False
            found = held[near].tolist()
            edges += [(p, x) for x in found]
            open_ += found
            if 2 * live.sum() < len(live):
                rest, place = held[live], 0
                hold()
    return edges


def _verified(similarity: float):
    """mapInArrow over rows sorted by (cluster, i, j): the links of one pair of a cluster's chunks after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = similar_forest(sets, similarity)
            if edges:
                n = np.array(nodes, np.int64)[np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(n[:, 0])), pa.array(np.ascontiguousarray(n[:, 1]))], ["a", "b"])

        now, nodes, sets = None, [], []
        for b in batches:
            for cluster, i, j, node, data in (tuple(v.as_py() for v in row) for row in zip(*b.columns)):
                if now != (cluster, i, j):
                    if len(nodes) > 1:
                        yield from out(nodes, sets)
                    now, nodes, sets = (cluster, i, j), [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, "<u8"))
        if len(nodes) > 1:
            yield from out(nodes, sets)
        del nodes, sets
        give_back()

    return run


def _links(docs: DataFrame, clusters: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) of texts of a cluster of candidates that join all of the exact similarity. docs: doc_id, __text; clusters: node, least, component."""

    def run(texts: pa.Array) -> pa.Array:
        nodes, sizes, sets = [], [], []
        for t in texts:  # one text at a time, to bound memory
            found = distinct_shingles(t.as_py(), shingle)
            nodes.append(node_of(found))
            sizes.append(len(found))
            sets.append(found.tobytes())
        fields = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
        return pa.StructArray.from_arrays(fields, ["node", "n", "shingles"])

    members = docs.join(clusters.select(F.col("least").alias("__least")).distinct(), F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi")
    sets = append_columns(members, ["__text"], run, "node bigint, n bigint, shingles binary").select("node", "n", "shingles")
    sets = written(sets.join(clusters.select("node", F.col("component").alias("cluster")), "node").dropDuplicates(["node"]), "shingles")
    parts = F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("n") / CLUSTER_SHINGLES))
    sizes = written(sets.groupBy("cluster").agg(F.count("*").alias("texts"), parts.alias("chunks")).where("texts > 1"), "cluster-sizes")
    last = F.col("chunks") - 1
    # a pair of chunks is compared within the chunks too, so a chunk has a task of its own only where there is no other
    others = F.when(last == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), last), lambda k: k != F.col("mine")))
    tasks = (
        spread_join(sets, sizes, "cluster", "texts", 2 * CLUSTER)
        .withColumn("mine", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")))
        .withColumn("other", F.explode(others))
        .select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "shingles")
    )
    place = ["cluster", "i", "j"]
    return tasks.repartition(*place).sortWithinPartitions(*place).mapInArrow(_verified(similarity), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id and component_id (the smallest id reachable by links of the similarity) for each row of docs."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    marked = written(sketched(ids, "__text", shingle).drop("__text"), "sketches")
    least = written(marked.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    one = marked.groupBy("node").agg(F.first("print").alias("print"), F.first("bands").alias("bands"))
    dealt = one.select("node", "print", F.explode("bands").alias("key"))
    sizes = written(dealt.groupBy("key").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / CHUNK)), "buckets")
    tasks = (
        spread_join(dealt, sizes, "key", "count")
        .withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "print")
    )
    place = ["key", "i", "j"]
    found = tasks.repartition(*place).sortWithinPartitions(*place, "mine", "node").mapInArrow(_bucketed(WIDE), "a bigint, b bigint")
    clusters = written(components(found).withColumnRenamed("node", "member").join(least, F.col("member") == F.col("node")).select("node", "least", "component"), "clusters")
    joined = components(_links(ids, clusters, similarity, shingle))
    named = least.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(smallest, "component").select("node", "component_id")
    return marked.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id. Rows that repeat an id are one
    document. Rows with a null id stay only if no document of their group has an id."""
    rows, names = own_names(docs)
    found = near_groups(rows, names[id_col], names[text_col], similarity, shingle)
    kept = found.where("doc_id <=> component_id").select("doc_id").distinct()
    left = rows.join(kept, F.col(names[id_col]).eqNullSafe(F.col("doc_id")), "left_semi")
    return left.select(*[F.col(i).alias(c) for c, i in names.items()])
