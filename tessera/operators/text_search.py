"""A kept index for words in texts: positional postings by word, stems, ranks with an early end by block maxima, substrings, names.

Documents are dealt by a hash of their id into blocks of about BLOCK_DOCS. A row of the postings is a word in a block: its documents, their days and
the word's places in each, and the most places it has in one of them (several rows, if the block has very many words). So no row grows with the documents, however common the word. Postings
are in shards by a hash of the word, sorted by word and block. The vocabulary has each word once, with its lexeme (its stem, but for
stop-words). Only it is searched for substrings: a term has letters, digits and hyphens only, so it lies within a word, or within a run of
words and hyphens, which is a word of its own without a lexeme. The empty word has every document. Texts are read when the index is built, and never at query time.

A query is read as web searches are: words must all occur, `or` between words parts alternatives, quotes make phrases, a hyphen before a
word or phrase excludes it. A document matches if the query does, if it holds a term, or if one of its names does. Rank is by places:
with one word, or alternatives, by how often; else by the distances of different words.

Matching reads documents and days of the words' rows, places only for phrases; it gives the count and what may be on the page. Ranking
reads places only in blocks whose maxima allow a rank as high as the page's lowest one among the blocks of highest maxima.

Ids are keys: rows with an equal id are one document. Null ids and null texts, and texts without words, are found by names and exclusions only (null ids by nothing).
Very long texts are indexed whole. Ties in rank go to the later day, undated last, then to the larger id. Empty tables: no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP, stem
from ..session import delete, shared_dir, ship

BLOCK_DOCS, SHARDS, PARTS = 128, 16, 16
#: Texts that are read at once, and words of a block's texts beyond which rows are made of them.
TEXTS, PLACES = 200, 2_000_000
#: Words of a query up to which the scan is filtered by them.
FEW_WORDS = 1000
POSTINGS = "word string, block bigint, ids array<bigint>, days array<date>, places array<array<int>>, most int, shard int"
WORD = re.compile(r"[^\W_]+")
JOINED = re.compile(r"(?:[^\W_]|-)*-(?:[^\W_]|-)*")
#: Fixed values of ranks: a place's weight, the sum of 1 / n^2, the distance beyond which words say little, and the rank of none.
WEIGHT, ALL_PLACES, FAR, FAR_WEIGHT, NO_RANK = 0.1, 1.64493406685, 100, 1e-30, 1e-20


def lexeme(word: str) -> str | None:
    return None if word in STOP else stem(word)


@dataclass(frozen=True)
class Item:
    """A word or phrase of a query: lexemes and how far each is behind the first."""

    lexemes: tuple[str, ...]
    offsets: tuple[int, ...]
    excluded: bool = False


def parsed(question: str) -> list[list[Item]]:
    """Alternatives of items that must all hold."""
    groups: list[list[Item]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', question.lower()):
        plain = m[3]
        if plain == "or":
            groups.append([])
            continue
        excluded = bool(m[1]) if plain is None else plain.startswith("-")
        found = [(i, lexeme(w)) for i, w in enumerate(WORD.findall(m[2] if plain is None else plain))]
        found = [(i, x) for i, x in found if x]
        if found:
            groups[-1].append(Item(tuple(x for _, x in found), tuple(i - found[0][0] for i, _ in found), excluded))
    return [g for g in groups if g]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def build(docs: DataFrame, store: str, key: str, text: str, day: str | None = None) -> None:
    """Writes postings, vocabulary and the number of blocks."""
    spark = ship(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), (F.col(day) if day else F.lit(None)).cast("date").alias("day"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")
    )
    blocks = max(1, -(-rows.count() // BLOCK_DOCS))
    spark.createDataFrame([(blocks,)], "blocks bigint").coalesce(1).write.parquet(f"{store}/about")
    # texts go to the tasks of their blocks, so that a word's places in a block are gathered there, before words are shuffled
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select("id", "day", _block(F.col("id"), blocks).alias("block"), "text").repartition(parts, "block").sortWithinPartitions("block")
    each = sorted_.mapInArrow(_postings, POSTINGS.removesuffix(", shard int"))
    shard = F.pmod(F.xxhash64("word"), F.lit(SHARDS)).cast("int")
    # a word's blocks are spread over PARTS, so that no task gets all rows of a common word
    dealt = each.select("*", shard.alias("shard"), (F.col("block") % PARTS).alias("part")).repartition(parts, "shard", "part").drop("part")
    dealt.sortWithinPartitions("shard", "word", "block").write.partitionBy("shard").parquet(f"{store}/postings")
    stems = F.arrow_udf(lambda w: pa.array([lexeme(x) if WORD.fullmatch(x) else None for x in w.to_pylist()], pa.string()), "string")
    vocabulary = spark.read.schema(POSTINGS).parquet(f"{store}/postings").select("shard", "word").distinct()
    vocabulary.withColumn("lexeme", stems("word")).sortWithinPartitions("lexeme").write.parquet(f"{store}/vocabulary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the postings of texts that are sorted by block: each word with its places; also runs with hyphens, and the empty word."""
    ids, days, row, word, flat, ends, block = [], [], [], [], [], [0], None

    def rows() -> pa.RecordBatch:
        """What is held, by word."""
        coded = pa.array(word, pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        order, starts = np.argsort(codes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(codes))])
        most = np.maximum.reduceat(np.diff(ends)[order], starts[:-1])
        of = lambda x: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x.take(pa.array(order)))
        each = [pa.array(ids, pa.int64()).take(pa.array(row, pa.int32())), pa.array(days, pa.int32()).cast(pa.date32()).take(pa.array(row, pa.int32()))]
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array([block] * len(most), pa.int64()), *(of(x) for x in (*each, places)), pa.array(most, pa.int32())], ["word", "block", "ids", "days", "places", "most"])

    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            part = b.slice(at, TEXTS)
            for id_, day, where, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.int32()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if ids and (where != block or len(flat) > PLACES):
                    yield rows()
                    ids, days, row, word, flat, ends = [], [], [], [], [], [0]
                found: dict[str, list[int]] = {"": []}
                for i, w in enumerate(WORD.findall(t), 1):
                    if w in found:
                        found[w].append(i)
                    else:
                        found[w] = [i]
                if "-" in t:
                    found.update({w: [] for w in JOINED.findall(t)})
                row += [len(ids)] * len(found)
                word += found
                for p in found.values():
                    flat += p
                    ends.append(len(flat))
                ids.append(id_)
                days.append(day)
                block = where
    if ids:
        yield rows()


def _needed(groups: list[list[Item]]) -> list[str]:
    return sorted({x for g in groups for i in g for x in i.lexemes})


def _near(distance: Column) -> Column:
    """What two words at a distance say together."""
    w = F.when(distance > FAR, F.lit(FAR_WEIGHT)).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))
    return WEIGHT * F.sqrt(w)


def rank_of(places: list[Column], by_distance: bool) -> Column:
    """Rank of a document by its places of each of the query's lexemes (empty arrays: none)."""
    if not by_distance:
        often = [F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0.0), lambda s, n: s + 1 / (n * n)) for p in places]
        total = sum((F.when(F.size(p) > 0, o).otherwise(0.0) for p, o in zip(places, often)), F.lit(0.0))
        return WEIGHT * total / ALL_PLACES / max(1, len(places))


    def apart(a: Column, b: Column) -> Column:
        """What all pairs of two words' places leave of one."""
        one = lambda x, y: 1 - F.when(x == y, F.lit(0.0)).otherwise(_near(F.abs(x - y)))
        return F.aggregate(a, F.lit(1.0), lambda s, x: F.aggregate(b, s, lambda t, y: t * one(x, y)))

    left = F.lit(1.0)
    for i in range(1, len(places)):
        for k in range(i):
            left = left * apart(places[i], places[k])
    return F.when(left < 1, 1 - left).otherwise(F.lit(NO_RANK))


def most_of(most: list[Column], by_distance: bool) -> Column:
    """No document's rank is above it, if it has no lexeme more often."""
    if not by_distance:
        often = [F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, n: s + 1 / (n * n))).otherwise(0.0) for m in most]
        return WEIGHT * sum(often, F.lit(0.0)) / ALL_PLACES / max(1, len(most))
    pairs = sum((most[i].cast("double") * most[k] for i in range(1, len(most)) for k in range(i)), F.lit(0.0))
    return F.greatest(1 - F.pow(1 - _near(F.lit(1.0)), pairs), F.lit(NO_RANK))


def _phrase(item: Item, places: dict[str, Column]) -> Column:
    first = places[item.lexemes[0]]
    rest = list(zip(item.lexemes[1:], item.offsets[1:]))
    if not rest:
        return F.size(first) > 0

    def here(x: Column) -> Column:
        out = F.array_contains(places[rest[0][0]], x + rest[0][1])
        for lex, off in rest[1:]:
            out = out & F.array_contains(places[lex], x + off)
        return out

    return F.exists(first, here)


def search(
    spark: SparkSession, store: str, question: str, terms: list[str] = (), limit: int = 100, names: DataFrame | None = None, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """id, day, rank (seven places) of the page, best first, and match_count, the number of all that match.

    names: id, name (and day, where documents without words are to be found) of what documents are about. The page, of `limit` rows, is made on the driver.
    """
    groups, terms = parsed(question), [t.lower() for t in terms if t]
    lexemes = _needed(groups)
    by_distance = len(groups) == 1 and len(lexemes) > 1
    empty = spark.createDataFrame([], "id bigint, day date, rank double, match_count bigint")
    if not groups and not terms:
        return empty
    word, sub = F.col("word"), F.lit(False)
    for t in terms:
        sub = sub | word.contains(t)
    every = any(all(i.excluded for i in g) for g in groups)
    number = F.coalesce(*[F.when(F.col("lexeme") == x, F.lit(i)) for i, x in enumerate(lexemes)], F.lit(-1))
    words = spark.read.schema("shard int, word string, lexeme string").parquet(f"{store}/vocabulary").select("shard", "word", number.alias("item"), sub.alias("sub"))
    words = words.where((F.col("item") >= 0) | F.col("sub") | (F.lit(every) & (word == "")))
    shards = [r.shard for r in words.select("shard").distinct().collect()]  # SHARDS at most
    few = [r.word for r in words.select("word").limit(FEW_WORDS + 1).collect()]
    postings = spark.read.schema(POSTINGS).parquet(f"{store}/postings")
    postings = postings.where(F.col("shard").isin(shards)) if shards else postings.limit(0)
    if len(few) <= FEW_WORDS:
        postings = postings.where(word.isin(few))
    hits = postings.join(words, ["shard", "word"])
    lists = lambda: [F.array_sort(F.flatten(F.collect_list(F.when(F.col("item") == i, F.col("e.places"))))).alias(f"p{i}") for i in range(len(lexemes))]
    placed = lambda rows: rows.select("block", "item", F.explode(F.arrays_zip("ids", "days", "places")).alias("e"))
    phrases = any(len(i.lexemes) > 1 for g in groups for i in g)
    entry = F.arrays_zip("ids", "days", "places") if phrases else F.arrays_zip("ids", "days")
    each = hits.select("block", "item", "sub", F.explode(entry).alias("e"))
    bits = [F.max(F.col("item") == i).alias(f"b{i}") for i in range(len(lexemes))]
    docs = each.groupBy("block", F.col("e.ids").alias("id")).agg(F.max("e.days").alias("day"), F.bool_or("sub").alias("sub"), *(lists() if phrases else bits))
    places = {x: F.col(f"p{i}") for i, x in enumerate(lexemes)}
    holds = lambda i: _phrase(i, places) if phrases else F.col(f"b{lexemes.index(i.lexemes[0])}")
    match = F.col("sub")
    for g in groups:
        every_item = F.lit(True)
        for i in g:
            every_item = every_item & (~holds(i) if i.excluded else holds(i))
        match = match | every_item
    found = docs.where(match).select("block", "id", "day")
    if names is not None and terms:
        name = F.lower("name")
        hit = name.contains(terms[0])
        for t in terms[1:]:
            hit = hit | name.contains(t)
        day = F.col("day").cast("date") if "day" in names.columns else F.lit(None).cast("date")
        named = names.where(hit & F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), day.alias("day"))
        blocks = spark.read.parquet(f"{store}/about").head().blocks
        found = found.unionByName(named.select(_block(F.col("id"), blocks).alias("block"), "id", "day")).groupBy("id").agg(F.max("block").alias("block"), F.max("day").alias("day"))
    if first_day:
        found = found.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        found = found.where(F.col("day") <= F.lit(last_day).cast("date"))
    path = f"{shared_dir(spark)}/tessera/matches-{uuid.uuid4().hex}"
    found.select("id", "block", "day").write.parquet(path)
    matched = spark.read.schema("id bigint, block bigint, day date").parquet(path)
    count = matched.count()
    order = [F.desc("rank"), F.col("day").desc_nulls_last(), F.desc("id")]

    def ranked(within: DataFrame) -> DataFrame:
        """Matches of these blocks with their ranks."""
        own = placed(hits.where("item >= 0").join(within, "block")).groupBy(F.col("e.ids").alias("id")).agg(*lists())
        cells = [F.coalesce(f"p{i}", F.array().cast("array<int>")) for i in range(len(lexemes))]
        return matched.join(within, "block", "left_semi").join(own, "id", "left").select("id", "day", F.round(rank_of(cells, by_distance), 7).alias("rank"))

    page = matched.select("id", "day", F.lit(0.0).alias("rank"))
    if lexemes:
        most = [F.sum(F.when(F.col("item") == i, F.col("most")).otherwise(0)).cast("int").alias(f"m{i}") for i in range(len(lexemes))]
        maxima = hits.where("item >= 0").groupBy("block").agg(*most).select("block", most_of([F.col(f"m{i}") for i in range(len(lexemes))], by_distance).alias("top"))
        maxima = matched.select("block").distinct().join(maxima, "block", "left").select("block", F.coalesce("top", F.lit(0.0)).alias("top"))
        best = ranked(maxima.orderBy(F.desc("top"), "block").limit(limit).select("block")).orderBy(*order).limit(limit).collect()
        least = best[-1]["rank"] if len(best) == limit else -1.0
        page = ranked(maxima.where(F.col("top") >= least - 2e-7).select("block"))
    rows = [(r.id, r.day, float(np.round(r["rank"], 7)), count) for r in page.orderBy(*order).limit(limit).collect()]
    delete(spark, path)
    return spark.createDataFrame(rows, empty.schema)
