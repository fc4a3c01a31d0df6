"""Star clusters of cells in which very many pairs could join: claims meet anchors only, in blocks, and pairs are never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import PAIR_WEIGHTS
from ..session import ship, written
from .sampling import numbered

#: Claims of a cell that one task decides in order and keys that it holds; claims of a cell that meet anchors in one task and keys of these.
IN_ORDER, KEYS_IN_ORDER, GROUP, KEYS_OF_GROUP = 4096, 8_000_000, 10_240, 16_000_000
#: Claims that are counted together; those that are compared at once with all of a task.
BLOCK, AT_ONCE = 64, 32
#: Sets of a claim: tokens and entities that aren't frequent in its cell and that are, and hints.
SETS = ("tl", "th", "el", "eh", "h")


class _Claims:
    """Claims of a cell with an index of their sets, to be compared with others."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows, self.n = rows, rows["n"].to_numpy()
        self.day = rows["d"].to_numpy().astype(float)  # null: NaN, at most a day from nothing
        self.sets = {c: _flat(rows[c]) for c in (*SETS, "u")}
        self.size = {c: np.diff(self.sets[c][1]) for c in SETS}
        self.index = {}
        for c in SETS:
            values, ends = self.sets[c]
            order = np.argsort(values, kind="stable")
            keys, first = np.unique(values[order], return_index=True)
            self.index[c] = keys, first, np.diff(np.append(first, len(values))), np.repeat(np.arange(len(rows)), np.diff(ends))[order]

    def of(self, c: str, k: int) -> np.ndarray:
        values, ends = self.sets[c]
        return values[ends[k] : ends[k + 1]]

    def shared(self, c: str, other: _Claims, begin: int, end: int) -> np.ndarray | None:
        """How many elements of set c each of other's claims from begin to end shares with each claim here; nothing if none does."""
        (keys, first, many, owner), (values, ends) = self.index[c], other.sets[c]
        asked, of = values[ends[begin] : ends[end]], np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1]))
        if not len(keys) or not len(asked):
            return None
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        at, of = at[hit], of[hit]
        times = many[at]
        place = np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.bincount(owner[place] + np.repeat(of * len(self.n), times), minlength=(end - begin) * len(self.n)).reshape(end - begin, -1)

    def reached(self, other: _Claims, begin: int, end: int, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of other's claims (by their place from begin on) and those here that reach the threshold with a key in common, at most a day apart: places, scores, and whether a key is not frequent."""
        shape = end - begin, len(self.n)
        counts = {c: self.shared(c, other, begin, end) for c in SETS}
        size = lambda x, a: x.size[f"{a}l"] + x.size[f"{a}h"]
        both = lambda *c: sum((counts[x] for x in c if counts[x] is not None), np.zeros(shape, np.int64))
        tokens, here, there = both("tl", "th"), size(self, "t"), size(other, "t")[begin:end]
        part = least / (1 + least)
        a, i = np.nonzero(tokens >= part * here[None, :] + (part * there[:, None] - 1e-6))  # others have too few tokens in common, whatever else they share
        near = np.abs(other.day[begin + a] - self.day[i]) <= 1
        a, i = a[near], i[near]
        at = lambda c: np.zeros(len(a), np.int64) if counts[c] is None else counts[c][a, i]
        light, heavy, entities = at("tl") + at("el"), at("th") + at("eh"), at("el") + at("eh")
        total, weight = np.zeros(len(a)), np.zeros(len(a))
        of = ((tokens[a, i], here[i], there[a]), (entities, size(self, "e")[i], size(other, "e")[begin:end][a]), (at("h"), self.size["h"][i], other.size["h"][begin:end][a]))
        for w, (common, x, y), always in zip(PAIR_WEIGHTS, of, (True, False, False)):
            counted = (x > 0) & (y > 0) | always
            total += np.where(counted, w * (common / np.maximum(x + y - common, 1)), 0.0)
            weight += np.where(counted, w, 0.0)
        score = total / weight
        kept = (score >= threshold) & (light + heavy > 0)
        return a[kept], i[kept], score[kept], light[kept] > 0

    def common(self, i: int, other: _Claims, a: int) -> set[int]:
        """Frequent keys that two claims have in common."""
        return {*self.of("th", i).tolist(), *self.of("eh", i).tolist()} & {*other.of("th", a).tolist(), *other.of("eh", a).tolist()}


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of lists."""
    one = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    ends = one.offsets.to_numpy()
    return one.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def _least(threshold: float, hints: bool) -> float:
    """The least Jaccard similarity of tokens of any pair that reaches the threshold."""
    text, entity, hint = PAIR_WEIGHTS
    return max(0.0, min((threshold * (text + w) - w) / text for w in ((0.0, entity, hint, entity + hint) if hints else (0.0, entity))) - 1e-9)


def _in_order(rows: pa.Table, state: pa.Table, threshold: float, least: float) -> pa.Table:
    """Of a cell's next claims the anchors (n), and what became of its frequent keys (key, most, so_far: anchors with it, until: the anchor with which it stopped being of use)."""
    rows = rows.sort_by("n")
    claims, m = _Claims(rows), rows.num_rows
    most = dict(zip(state["key"].to_pylist(), state["most"].to_pylist()))
    so_far, until = dict(zip(most, state["so_far"].to_pylist())), dict(zip(most, state["until"].to_pylist()))
    anchor, taken = np.zeros(m, bool), []
    for begin in range(0, m, AT_ONCE):
        end = min(begin + AT_ONCE, m)
        x, y, _, sure = claims.reached(claims, begin, end, threshold, least)
        bounds = np.searchsorted(x, np.arange(end - begin + 1))
        for k in range(begin, end):
            js, safe = y[bounds[k - begin] : bounds[k - begin + 1]], sure[bounds[k - begin] : bounds[k - begin + 1]]
            before = (js < k) & anchor[js]
            joins = bool((before & safe).any()) or any(so_far[u] <= most[u] for u in claims.of("u", k).tolist())
            joins = joins or any(so_far[u] <= most[u] for j in js[before & ~safe].tolist() for u in claims.common(k, claims, j))
            if joins:
                continue
            anchor[k] = True
            taken.append(int(claims.n[k]))
            for u in (*claims.of("th", k).tolist(), *claims.of("eh", k).tolist()):
                so_far[u] += 1
                if so_far[u] == most[u] + 1:
                    until[u] = int(claims.n[k])
    cell, none, nothing = rows["cell"][0].as_py(), [None] * len(taken), [None] * len(most)
    columns = [[cell] * (len(taken) + len(most)), taken + nothing, none + list(most), none + list(most.values()), none + list(so_far.values()), none + list(until.values())]
    return pa.table([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["cell", "n", "key", "most", "so_far", "until"])


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[_Claims]]]:
    """Of rows in the order of cell, grp, kind and n the claims (kind 0) of each group, and a function that goes through its anchors (kind 1), some at a time."""

    def parts() -> Iterator[tuple[tuple, pa.Table]]:
        for b in batches:
            keys = list(zip(b["cell"].to_pylist(), b["grp"].to_pylist(), b["kind"].to_pylist()))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[begin]:
                    yield keys[begin], pa.Table.from_batches([b.slice(begin, k - begin)])
                    begin = k

    rest, ahead = parts(), []

    def after(group: tuple, kind: int) -> Iterator[pa.Table]:
        while ahead or (found := next(rest, None)) is not None:
            key, part = ahead.pop() if ahead else found
            if key != (*group, kind):
                ahead.append((key, part))
                return
            yield part

    while ahead or (found := next(rest, None)) is not None:
        if not ahead:
            ahead.append(found)
        group = ahead[0][0][:2]
        claims = list(after(group, 0))
        yield (pa.concat_tables(claims) if claims else None), (_Claims(t) for t in after(group, 1))


def _undecided(batches: Iterator[pa.RecordBatch], threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    """The claims that surely join none of the anchors; u: frequent keys by which they join one while these are of use."""
    for rows, anchors in _by_group(batches):
        if rows is None:
            for _ in anchors:
                pass
            continue
        claims = _Claims(rows)
        open_, more = np.ones(len(rows), bool), [set(u) for u in rows["u"].to_pylist()]
        for some in anchors:
            if open_.mean() < 0.6:  # fewer to compare with
                kept = np.flatnonzero(open_)
                rows, more = rows.take(pa.array(kept)), [more[k] for k in kept.tolist()]
                claims, open_ = _Claims(rows), np.ones(len(kept), bool)
            for begin in range(0, len(some.n) if len(rows) else 0, AT_ONCE):
                end = min(begin + AT_ONCE, len(some.n))
                a, i, _, sure = claims.reached(some, begin, end, threshold, least)
                open_[i[sure]] = False
                for x, y in zip((begin + a[~sure]).tolist(), i[~sure].tolist()):
                    if open_[y]:
                        more[y] |= claims.common(y, some, x)
        kept = np.flatnonzero(open_)
        left = rows.take(pa.array(kept)).set_column(rows.schema.get_field_index("u"), "u", pa.array([sorted(more[k]) for k in kept.tolist()], pa.list_(pa.int64())))
        yield from left.combine_chunks().to_batches()


def _joined(batches: Iterator[pa.RecordBatch], threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    """n of each claim and of the best anchor before it; u: frequent keys that are of use to it no more."""
    for rows, anchors in _by_group(batches):
        if rows is None:
            for _ in anchors:
                pass
            continue
        claims = _Claims(rows)
        best, to, gone = np.full(len(rows), -1.0), np.full(len(rows), -1), [set(u) for u in rows["u"].to_pylist()]
        for some in anchors:
            for begin in range(0, len(some.n), AT_ONCE):
                end = min(begin + AT_ONCE, len(some.n))
                a, i, score, valid = claims.reached(some, begin, end, threshold, least)
                before = some.n[begin + a] < claims.n[i]
                a, i, score, valid = a[before], i[before], score[before], valid[before]
                for k in np.flatnonzero(~valid).tolist():
                    valid[k] = bool(claims.common(int(i[k]), some, begin + int(a[k])) - gone[i[k]])
                a, i, score = a[valid], i[valid], score[valid]
                order = np.lexsort((a, -score, i))  # of each claim the best first, of equal ones the earliest
                a, i, score = a[order], i[order], score[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                better = first[score[first] > best[i[first]]]
                best[i[better]], to[i[better]] = score[better], some.n[begin + a[better]]
        yield pa.RecordBatch.from_arrays([pa.array(claims.n[to >= 0]), pa.array(to[to >= 0])], ["n", "anchor_n"])


def joined(rows: DataFrame, often: DataFrame, threshold: float, hints: bool) -> DataFrame:
    """cell, id, anchor: the claims that join one. rows has cell, id, t, e, h (hashed sets), d, heavy; often: the frequent keys of cells (cell, key, most).

    In rounds, one task for a cell decides its next claims in their order, and the later claims meet the anchors found: those that share a key which is not frequent with one are decided.
    Others wait for their turn, with the keys that could bring them to an anchor. Once all anchors are known, each other claim takes its best. A task holds a group of claims, whose number is bounded
    also by their keys, while anchors pass by; no pair is shuffled or written. The comparisons are those of claims and the anchors before them.
    """
    spark, least = ship(rows.sparkSession), _least(threshold, hints)
    split = [F.array_except("t", "heavy").alias("tl"), F.array_intersect("t", "heavy").alias("th"), F.array_except("e", "heavy").alias("el"), F.array_intersect("e", "heavy").alias("eh")]
    facts = rows.select("cell", "id", *split, "h", F.unix_date("d").alias("d"), F.array().cast("array<bigint>").alias("u"), F.struct("cell", "id").alias("o"))
    claims = numbered(facts, "o", "n").drop("o")
    keys = sum((F.size(c) for c in SETS), F.lit(0))
    stats = claims.groupBy("cell", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.count("*").alias("claims"), F.sum(keys).alias("keys")).agg(F.sum("claims"), F.max("keys")).head()
    total, largest = stats[0] or 0, max(1, stats[1] or 1)
    in_order = min(IN_ORDER, BLOCK * max(1, KEYS_IN_ORDER // largest))
    group = min(GROUP, BLOCK * max(1, KEYS_OF_GROUP // largest), BLOCK * max(8, total // (8 * BLOCK * spark.sparkContext.defaultParallelism)))
    names = ["cell", "n", *SETS, "d", "u"]
    left, state = claims.select(*names), often.select("cell", "key", "most", F.lit(0).cast("bigint").alias("so_far"), F.lit(None).cast("bigint").alias("until"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # as many as said: few bytes may be much work
    block, found, ends = F.floor(F.col("n") / BLOCK), [], []
    kind = "cell string, n bigint, key bigint, most bigint, so_far bigint, until bigint"
    passing = lambda some, k: some.select(F.lit(k).alias("kind"), "grp", *names)

    def meeting(some: DataFrame, anchors: DataFrame) -> DataFrame:
        """Claims with the anchors of their cell, those behind each group of claims."""
        some = some.withColumn("grp", F.floor(F.col("n") / group))
        near = anchors.join(some.groupBy("cell", "grp").agg(F.max("n").alias("last")), "cell").where(F.col("n") < F.col("last"))
        both = passing(some, 0).unionByName(passing(near, 1))
        return both.repartition(tasks, "cell", "grp").sortWithinPartitions("cell", "grp", "kind", "n")

    while True:
        running = F.sum("count").over(Window.partitionBy("cell").orderBy("block"))
        counts = left.groupBy("cell", block.alias("block")).count().withColumn("running", running)
        upto = written(counts.groupBy("cell").agg(F.coalesce(F.max(F.when(F.col("running") <= in_order, F.col("block"))), F.min("block")).alias("upto")), "star-upto")
        marked = left.join(upto, "cell")
        now, later = marked.where(block <= F.col("upto")).drop("upto"), marked.where(block > F.col("upto")).drop("upto")
        told = written(now.groupBy("cell").cogroup(state.groupBy("cell")).applyInArrow(lambda x, y: _in_order(x, y, threshold, least) if x.num_rows else pa.table({f.name: pa.array([], f.type) for f in _KIND}, schema=_KIND), kind), "star-told")
        anchors = written(now.join(told.where("n is not null").select("n"), "n", "left_semi").select(*names), "star-anchors")
        found.append(anchors)
        state = told.where("key is not null").drop("n")
        ends.append(state.where("until is not null").select("cell", "key", "until"))
        if later.isEmpty():
            break
        rest = meeting(later, anchors).mapInArrow(lambda b: _undecided(b, threshold, least), passing(left.withColumn("grp", F.lit(0).cast("bigint")), 0).schema)
        left = written(rest.select(*names), "star-left")
        if left.isEmpty():
            break
    anchors, over = found[0], ends[0]
    for more, other in zip(found[1:], ends[1:]):
        anchors, over = anchors.unionByName(more), over.unionByName(other)
    others = claims.select(*names).join(anchors.select("n"), "n", "left_anti")
    mine = others.select("cell", "n", F.explode(F.concat("th", "eh")).alias("key"))
    gone = mine.join(over.distinct(), ["cell", "key"]).where("n > until").groupBy("n").agg(F.collect_list("key").alias("gone"))
    others = others.join(gone, "n", "left").withColumn("u", F.coalesce("gone", "u")).drop("gone")
    best = written(meeting(others, anchors).mapInArrow(lambda b: _joined(b, threshold, least), "n bigint, anchor_n bigint"), "star-best")
    ids = claims.select("n", "cell", "id")
    return best.join(ids, "n").join(ids.select(F.col("n").alias("anchor_n"), F.col("id").alias("anchor")), "anchor_n").select("cell", "id", "anchor")


_KIND = pa.schema([("cell", pa.string()), *((c, pa.int64()) for c in ("n", "key", "most", "so_far", "until"))])
