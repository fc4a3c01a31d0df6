"""Clusters of claims and what they say: star clustering, independent sources, mixes of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import PAIR_WEIGHTS
from ..functions.text import is_meta_claim
from ..session import spread, written
from . import star_blocks
from .near_duplicates import first_in_order

#: The score from which on a claim joins a group; a key is of use while no more than this share of a cell's claims (and this many) are anchors with it.
JOIN_AT, OFTEN, OFTEN_LEAST = 0.35, 0.25, 20
#: Claims of a cell up to which all its pairs are compared; those of larger cells meet over rare keys.
SMALL_CELL = 64
#: A larger cell goes by blocks if its claims have more tokens than so many on average, or if its entities bring more pairs than so many for each claim.
LONG_CLAIM, MANY_PAIRS = 64, 64


def _shares(threshold: float, hints: bool) -> float:
    """The least Jaccard similarity of tokens or of entities of any pair that reaches the threshold."""
    text, entity, hint = PAIR_WEIGHTS
    cases = [(text, 0.0), (text + entity, 0.0), *([(text, hint), (text + entity, hint)] if hints else [])]
    return max(0.0, min((threshold * (w + h) - h) / w for w, h in cases) - 1e-9)


def _score(a: str, b: str) -> Column:
    """reduction.pair_score() of two rows with arrays t, e and h, by the numbers of what they share (shared_t, shared_e, shared_h)."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, c in zip(PAIR_WEIGHTS, "teh"):
        x, y, shared = F.size(f"{a}.{c}"), F.size(f"{b}.{c}"), F.col(f"shared_{c}")
        there = F.lit(True) if c == "t" else (x > 0) & (y > 0)
        total, weight = total + F.when(there, w * F.coalesce(F.try_divide(shared, x + y - shared), F.lit(0.0))).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return total / weight


def _rarest(rows: DataFrame, column: str, counts: DataFrame, share: float) -> DataFrame:
    """cell, id, n, key: of each set the rarest elements, so many that sets with that share in common have one of them in common."""
    each = rows.select("cell", "id", F.size(column).alias("n"), F.explode(column).alias("key")).join(counts, ["cell", "key"])
    # the number of rarer elements of the same set, by a window: the set of a long text isn't gathered
    place = F.row_number().over(Window.partitionBy("cell", "id").orderBy("df", "key"))
    kept = F.col("n") - F.greatest(F.ceil(F.col("n") * share), F.lit(1)) + 1
    return each.withColumn("place", place).where((F.col("place") <= kept) & (F.col("df") > 1)).select("cell", "id", "n", "key")


def claim_links(rows: DataFrame, threshold: float, hints: bool) -> DataFrame:
    """cell, a, i, score, heavy: pairs of claims (a before i) that reach the threshold, at most a day apart, with a key in common.

    heavy: the hashes of their common keys, where all of these are frequent in the cell, else null. rows has cell, id, t, e, h (hashed sets), d, heavy.
    In cells of more than SMALL_CELL claims, pairs meet over the rarest tokens or entities of both, and only with sets of a size that can be alike, so frequent words
    bring nobody together.
    """
    share = _shares(threshold, hints)
    sizes = written(rows.groupBy("cell").agg(F.count("*").alias("claims")), "cell-sizes")
    ends = [F.col("x.cell").alias("cell"), F.col("x.id").alias("a"), F.col("y.id").alias("i")]
    ordered = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") < F.col("y.id")) & (F.abs(F.datediff("x.d", "y.d")) <= 1)
    of = F.struct("t", "e", "h", "heavy").alias("of")
    few = rows.select("cell", "id", "d", of).join(sizes.where(F.col("claims") <= SMALL_CELL), "cell", "left_semi")
    # a small cell's claims are shuffled, with their sets, not its pairs
    both = few.alias("x").join(few.alias("y").hint("merge"), ordered).select(*ends, F.col("x.of").alias("of_a"), F.col("y.of").alias("of_i"))
    large = sizes.where(F.col("claims") > SMALL_CELL)
    if not large.isEmpty():
        many, met = rows.join(large, "cell", "left_semi"), None
        for c in "te":
            counts = written(many.select("cell", F.explode(c).alias("key")).groupBy("cell", "key").agg(F.count("*").alias("df")), "claim-keys")
            prefix = written(_rarest(many, c, counts, share).join(many.select("cell", "id", "d"), ["cell", "id"]), "claim-prefixes")
            alike = (F.col("x.key") == F.col("y.key")) & (F.least("x.n", "y.n") >= share * F.greatest("x.n", "y.n"))
            by_key = prefix.alias("x").join(prefix.alias("y"), ordered & alike).select(*ends)
            met = by_key if met is None else met.unionByName(by_key)
        side = lambda o: many.select("cell", F.col("id").alias(o), of.alias(f"of_{o}"))
        both = both.unionByName(met.distinct().join(side("a"), ["cell", "a"]).join(side("i"), ["cell", "i"]))
    both = both.withColumns({f"shared_{c}": F.size(F.array_intersect(f"of_a.{c}", f"of_i.{c}")) for c in "teh"})
    both = both.withColumn("score", _score("of_a", "of_i")).where(F.col("score") >= threshold)
    common, all_common = F.array_intersect("of_a.heavy", "of_i.heavy"), F.col("shared_t") + F.col("shared_e")
    return both.where(all_common > 0).select("cell", "a", "i", "score", F.when(all_common == F.size(common), common).alias("heavy"))


def star_clusters(claims: DataFrame, cell: list[str], key: str, tokens: str, entities: str | None = None, hints: str | None = None, day: str | None = None, text: str | None = None, threshold: float = JOIN_AT) -> DataFrame:
    """cell, key, anchor: in the order of keys, each claim joins the best anchor before it that it reaches the threshold with (ties: the earliest), else it is an anchor.

    Claims meet anchors only, so groups don't chain. A word or actor that more anchors of a cell have than a quarter of its claims (20 at least) finds nobody from then on.
    Claims about the document, not the world, are left out where their text is given. Where a column of days is given, undated claims stay alone.

    All pairs that could join are found first; which claims are anchors is then a matter of order (first_in_order). Where pairs have only frequent keys
    in common, that hangs on how many anchors with a key came before: it is assumed that keys stay of use, then put right by the anchors found, until nothing
    changes. What comes first is right first, so that ends, mostly at once. Cells may be of any size; keys are unique and never null.

    In large cells of long texts, or of entities that very many claims share, most claims would meet: there claims meet anchors only (star_blocks).
    """
    rows = spread(claims) if text is None else spread(claims).where(~is_meta_claim(F.coalesce(F.col(text), F.lit(""))))
    hashed = lambda c, kind: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.xxhash64(F.lit(kind), x))) if c else F.array().cast("array<bigint>")
    dated = lambda c: F.when(F.col(day).isNotNull(), c).otherwise(F.array().cast("array<bigint>")) if day else c
    where = F.md5(F.to_json(F.struct(*cell), {"ignoreNullFields": "false"})).alias("cell")
    sets = [dated(hashed(c, n)).alias(n) for c, n in ((tokens, "t"), (entities, "e"), (hints, "h"))]
    facts = written(rows.select(*[F.col(c).alias(f"cell_{i}") for i, c in enumerate(cell)], where, F.col(key).alias("id"), *sets, (F.col(day) if day else F.lit("2000-01-01")).cast("date").alias("d")), "claims")
    sizes = facts.groupBy("cell").agg(F.greatest(F.lit(OFTEN_LEAST), F.ceil(F.count("*") * OFTEN)).alias("most"), F.count("*").alias("claims")).where(F.col("claims") > OFTEN_LEAST)
    each = facts.join(sizes, "cell").select("cell", "id", "most", F.explode(F.concat("t", "e")).alias("key"))
    often = written(each.groupBy("cell", "key").agg(F.count("*").alias("n"), F.first("most").alias("most")).where("n > most").select("cell", "key", "most"), "often")
    having = written(each.drop("most").join(often, ["cell", "key"]), "frequent-keys")
    own = having.groupBy("cell", "id").agg(F.collect_list("key").alias("heavy"))
    full = written(facts.join(own, ["cell", "id"], "left").withColumn("heavy", F.coalesce("heavy", F.array().cast("array<bigint>"))), "full-claims")
    named = full.select("cell", F.explode("e").alias("key")).groupBy("cell", "key").count().groupBy("cell").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"))
    long_ = full.groupBy("cell").agg(F.count("*").alias("claims"), F.avg(F.size("t")).alias("tokens")).where(F.col("claims") > SMALL_CELL).join(named, "cell", "left")
    blocks = written(long_.where((F.col("tokens") > LONG_CLAIM) | (F.col("pairs") > F.col("claims") * MANY_PAIRS)).select("cell"), "block-cells")
    whole = blocks.isEmpty()
    apart = None if whole else star_blocks.joined(full.join(blocks, "cell", "left_semi"), often.join(blocks, "cell", "left_semi"), threshold, hints is not None)
    links = written(claim_links(full if whole else full.join(blocks, "cell", "left_anti"), threshold, hints is not None), "claim-links")
    hanging, ends, usable = not links.where("heavy is not null").isEmpty(), None, links
    while True:
        o = lambda c: F.struct("cell", F.col(c).alias("id"))
        nodes = usable.select(o("a").alias("o_first"), o("i").alias("o_second"))
        first = written(first_in_order(nodes).select("o.cell", "o.id"), "anchors")
        joined = written(usable.join(first.withColumnRenamed("id", "i"), ["cell", "i"], "left_anti").join(first.withColumnRenamed("id", "a"), ["cell", "a"], "left_semi"), "joining")
        if not hanging:
            break
        # the anchor with which a frequent key stops being of use, if there is one
        anchors = having.join(joined.select("cell", F.col("i").alias("id")).distinct(), ["cell", "id"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("cell", "key").orderBy("id"))
        now = written(anchors.withColumn("turn", turn).where(F.col("turn") == F.col("most") + 1).select("cell", "key", F.col("id").alias("until")), "key-ends")
        same = ends is not None and now.exceptAll(ends).isEmpty() and ends.exceptAll(now).isEmpty()
        if same or (ends is None and now.isEmpty()):
            break
        ends = now
        by_key = links.where("heavy is not null").select("cell", "a", "i", "score", F.explode("heavy").alias("key")).join(ends, ["cell", "key"], "left")
        some = by_key.where(F.col("until").isNull() | (F.col("i") <= F.col("until"))).select("cell", "a", "i", "score").distinct()
        usable = written(links.where("heavy is null").select("cell", "a", "i", "score").unionByName(some), "claim-links")
    best = joined.groupBy("cell", "i").agg(F.min_by("a", F.struct(-F.col("score"), "a")).alias("anchor")).withColumnRenamed("i", "id")
    best = best if apart is None else best.unionByName(apart)
    found = facts.select(*[F.col(f"cell_{i}").alias(c) for i, c in enumerate(cell)], F.col("cell").alias("__cell"), F.col("id").alias(key))
    best = best.select(F.col("cell").alias("__cell"), F.col("id").alias(key), "anchor")
    return found.join(best, ["__cell", key], "left").select(*cell, key, F.coalesce("anchor", key).alias("anchor"))


def _within_caps(ordered: Column, cap: int, most: int) -> Column:
    """Places of the documents of a best-first list (place, adapter, platform) that are taken while none of their adapter or platform is at its cap."""
    none = F.array().cast("array<struct<place: int, adapter: string, platform: string>>")

    def step(taken: Column, x: Column) -> Column:
        of = lambda n: F.size(F.filter(taken, lambda t: t.getField(n) == x.getField(n)))
        return F.when((F.size(taken) < most) & (of("adapter") < cap) & (of("platform") < cap), F.concat(taken, F.array(x))).otherwise(taken)

    return F.aggregate(ordered, none, step)


def source_mix(docs: DataFrame, cell: list[str], key: str, adapter: str, platform: str, order: list, most: int, fraction: float = 0.4) -> DataFrame:
    """cell, key, place of the documents chosen for each cell: best first, of each adapter and platform at most a share; if that leaves room, those that
    were passed over, by turns of adapters. In the result, adapters take turns.

    Within one adapter and platform, no document beyond the `most` best can be chosen, so a cell's list is that long for each of them at most.
    """
    own, turn = Window.partitionBy(*cell, "__a"), F.col("__place")
    unknown = [F.coalesce(c, F.lit("unknown")).alias(n) for c, n in ((adapter, "__a"), (platform, "__p"))]
    best = docs.withColumn("__rn", F.row_number().over(Window.partitionBy(*cell, adapter, platform).orderBy(*order))).where(F.col("__rn") <= most)
    ranked = best.withColumn("__place", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).select(*cell, key, *unknown, "__place")
    taken = F.col("__place") <= most
    if fraction < 1:
        entry = F.struct(F.col("__place").alias("place"), F.col("__a").alias("adapter"), F.col("__p").alias("platform"))
        cap = max(1, -int(-most * fraction // 1))
        listed = ranked.groupBy(*[F.col(c).alias(f"__{c}") for c in cell]).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
        kept = F.transform(_within_caps(F.col("__all"), cap, most), lambda t: t.getField("place"))
        choice = listed.select(*[f"__{c}" for c in cell], kept.alias("__kept"))
        same = F.lit(True)
        for c in cell:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        ranked = ranked.join(choice, same).withColumn("__first", F.array_contains("__kept", F.col("__place"))).withColumn("__n", F.size("__kept"))
        again = F.row_number().over(own.orderBy("__first", "__place"))  # among those passed over, which come before the taken ones here
        late = ranked.withColumn("__turn", again).withColumn("__late", F.row_number().over(Window.partitionBy(*cell).orderBy("__first", "__turn", "__place")))
        ranked, taken = late, F.col("__first") | (~F.col("__first") & (F.col("__late") <= most - F.col("__n")))
    else:
        return ranked.where(taken).select(*cell, key, (turn - 1).alias("place"))
    chosen = ranked.where(taken).withColumn("__turn", F.row_number().over(own.orderBy("__place")))
    return chosen.select(*cell, key, (F.row_number().over(Window.partitionBy(*cell).orderBy("__turn", "__place")) - 1).alias("place"))


def threshold_sweep(pairs: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= threshold for each threshold, in one pass."""
    cols = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        cols += [F.count_if(hit & F.col(positive)).alias(f"tp{i}"), F.count_if(hit & ~F.col(positive)).alias(f"fp{i}"), F.count_if(~hit & F.col(positive)).alias(f"fn{i}")]
    one = pairs.agg(*cols)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    found = one.select(F.inline(rows))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return found.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))
