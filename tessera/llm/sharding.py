"""Sharding over fixed virtual slots (operator 12).

Records are hashed by their key into SLOTS virtual slots, whose number never changes. Bytes and rows are added up for each slot, and a map says which
shard has which slot. Maps are versions in a folder: the first deals slots out in turns; each later one is an edit of the one before. A
rebalance moves slots from the fullest shard to the emptiest until no slot's move makes them more alike; growth by a shard
moves slots only into it. So a version moves few records, and whole slots of them. Records never go through the driver: it edits a
table of SLOTS numbers.

A record's place in its shard is its place in its slot after the rows of the shard's slots before, so no task sorts a shard: it
sorts slots, each about 1 / SLOTS of all records. Only ids, sizes and checksums are shuffled.

Results: law is `bytes`: shards' sizes differ by less than the smallest slot that could move between them; a record (with its slot) that
is larger than a shard's share makes its shard larger. Null texts have no bytes and the crc32 of none, 0; empty ones alike. Very long texts count whole.
Null ids are hashed by their text. Rows with equal ids share a slot and are placed by checksum, then size; repeated rows are rows each.
Equal texts of different ids aren't kept together. An empty table has no rows and a map of empty slots. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written

#: Virtual slots, whatever the number of shards and records.
SLOTS = 16_384
#: Bytes that a record has beside its text.
FRAME = 16
MAP = "version int, virtual_slot int, shard int, n_bytes bigint, n_rows bigint, first bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual_slot of each record."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col)))
    slot = F.pmod(key, F.lit(SLOTS)).cast("int")
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + FRAME).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), slot.alias("virtual_slot"))


def loads(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot: SLOTS numbers each."""
    n_bytes, n_rows = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        n_bytes[r.virtual_slot], n_rows[r.virtual_slot] = r.b, r.n
    return n_bytes, n_rows


@dataclass(frozen=True)
class SlotMap:
    """Which shard has which virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def fresh(shards: int) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(SLOTS)))

    def held(self, n_bytes: list[int]) -> list[int]:
        """Bytes of each shard."""
        out = [0] * self.shards
        for shard, b in zip(self.shard_of, n_bytes):
            out[shard] += b
        return out

    def _by_size(self, n_bytes: list[int]) -> list[list[tuple[int, int]]]:
        """Of each shard the slots that have bytes, the smallest first."""
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for b, slot in sorted((b, s) for s, b in enumerate(n_bytes) if b):
            own[self.shard_of[slot]].append((b, slot))
        return own

    def rebalanced(self, n_bytes: list[int]) -> SlotMap:
        """The next version: slots go from the fullest shard to the emptiest while that makes the two more alike.

        The slot that goes is the largest of at most half their difference, else the smallest, if it is below the difference. A shard without one
        stays as it is from then on. Every move makes the sum of the squares smaller, so moves end.
        """
        own, held, to = self._by_size(n_bytes), self.held(n_bytes), list(self.shard_of)
        fullest = [(-b, s) for s, b in enumerate(held)]
        heapq.heapify(fullest)
        while fullest:
            b, full = heapq.heappop(fullest)
            if -b != held[full]:  # an entry of before a move
                continue
            empty = min(range(self.shards), key=lambda s: (held[s], s))
            gap = held[full] - held[empty]
            at = max(0, bisect_right(own[full], (gap // 2, SLOTS)) - 1)
            if not own[full] or own[full][at][0] >= gap:
                continue
            size, slot = own[full].pop(at)
            insort(own[empty], (size, slot))
            to[slot], held[full], held[empty] = empty, held[full] - size, held[empty] + size
            for s in (full, empty):
                heapq.heappush(fullest, (-held[s], s))
        return SlotMap(self.version + 1, self.shards, tuple(to))

    def grown(self, n_bytes: list[int]) -> SlotMap:
        """The next version, with one more shard: slots go into it from the fullest others until it has its share."""
        own, held, to, new = self._by_size(n_bytes), self.held(n_bytes), list(self.shard_of), 0
        share = sum(held) // (self.shards + 1)
        fullest = [(-b, s) for s, b in enumerate(held)]
        heapq.heapify(fullest)
        while fullest and new < share:
            full = heapq.heappop(fullest)[1]
            at = bisect_left(own[full], (share - new + 1, -1)) - 1  # the largest that still fits
            if at < 0:
                continue
            size, slot = own[full].pop(at)
            to[slot], held[full], new = self.shards, held[full] - size, new + size
            heapq.heappush(fullest, (-held[full], full))
        return SlotMap(self.version + 1, self.shards + 1, tuple(to))

    def save(self, spark: SparkSession, store: str, n_bytes: list[int] | None = None, n_rows: list[int] | None = None) -> None:
        """Writes this version with the slots' loads and the number of the shard's rows before each slot; a version is never replaced."""
        before, rows = [0] * self.shards, []
        for slot, shard in enumerate(self.shard_of):
            n = n_rows[slot] if n_rows else 0
            rows.append((self.version, slot, shard, n_bytes[slot] if n_bytes else 0, n, before[shard]))
            before[shard] += n
        spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{store}/map-{self.version}")


def read_map(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{store}/map-{version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard and slot: their place in the shard, from 0, without gaps. The map has SLOTS rows."""
    within = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    own = F.broadcast(slot_map.select("version", "virtual_slot", "shard", "first"))
    return numbered.join(own, "virtual_slot").withColumn("slot", (F.col("first") + F.col("at")).cast("bigint")).drop("at", "first")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard (null), virtual_slot, version. The versions are in the store: dealt in turns, then rebalanced."""
    spark = docs.sparkSession
    store = store or scratch(spark, "slot-maps")
    rows = written(digests(docs, id_col, text_col), "record-digests")
    n_bytes, n_rows = loads(rows)
    dealt = SlotMap.fresh(shards)
    dealt.save(spark, store, n_bytes, n_rows)
    even = dealt.rebalanced(n_bytes)
    even.save(spark, store, n_bytes, n_rows)
    found = place(rows, read_map(spark, store, even.version))
    return found.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version"
    )
