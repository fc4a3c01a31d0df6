"""Sources that are read by pages, forward and backward, in runs that can end anywhere.

Of each channel two marks are kept: all documents between them have been read. New ones lie above the upper mark and are read upward from it; the channel's past lies
below the lower mark and is read downward, newest first, until it ends or the floor is reached. A first contact starts at the newest document. A run admits so many channels,
those that were read longest ago first (never read ones before all), and so many documents of each; a burst that is larger goes on in the next run, also within a page.

A run is one commit: its documents and the marks after them become visible together (streaming.commits). A run that ends between pages, or whose task is
repeated, has committed nothing, so the next one reads the same again: no document is lost or there twice. Channels are read where Spark puts them; the driver sees marks, a row for each channel.

Channels without documents have empty marks. Documents of equal numbers are one: the first. A channel that fails says why in its mark's error and keeps its marks, and others go on.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written
from ..streaming.commits import Lease, Store
from .raw_documents import RAW_DOCUMENT

MARKS = "channel string, upper bigint, lower bigint, done boolean, turn bigint, error string"
_FOUND = "channel string, number bigint, document string, upper bigint, lower bigint, done boolean, error string"


class Paged(Protocol):
    def channels(self) -> list[str]:
        """What can be read apart."""

    def above(self, channel: str, number: int, size: int) -> list[tuple[int, dict]]:
        """At most `size` documents of larger numbers, ascending: a page."""

    def below(self, channel: str, number: int | None, size: int) -> list[tuple[int, dict]]:
        """At most `size` documents of smaller numbers (None: of any), descending: a page."""


class FixturePages:
    """Pages over literal documents: {channel: [[number, content], ...]}; a null instead of a channel's documents fails."""

    def __init__(self, options: dict[str, str]):
        self.rows = json.loads(options["fixture"])

    def channels(self) -> list[str]:
        return sorted(self.rows)

    def _all(self, channel: str) -> list[tuple[int, dict]]:
        if self.rows[channel] is None:
            raise ValueError(f"{channel} can't be read")
        return [(n, {"adapter": "fixture", "external_id": f"{channel}/{n}", "content": content}) for n, content in sorted(self.rows[channel])]

    def above(self, channel: str, number: int, size: int) -> list[tuple[int, dict]]:
        return [r for r in self._all(channel) if r[0] > number][:size]

    def below(self, channel: str, number: int | None, size: int) -> list[tuple[int, dict]]:
        return [r for r in reversed(self._all(channel)) if number is None or r[0] < number][:size]


def _made(options: dict[str, str]) -> Paged:
    module, _, name = options["adapter"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def read_channel(source: Paged, channel: str, upper: int | None, lower: int | None, done: bool, most: int, page: int, floor: int) -> Iterator[tuple[int, dict] | tuple[int | None, int | None, bool]]:
    """The channel's next documents, at most `most`, by pages; at last the marks after them. New ones come first, what room is left goes to the past."""
    left = most
    while upper is not None and left > 0:
        found = source.above(channel, upper, min(page, left))
        for number, doc in found:
            if number > upper:
                yield number, doc
                upper, left = number, left - 1
        if not found:
            break
    while not done and left > 0:
        found = source.below(channel, lower, min(page, left))
        for number, doc in found:
            if number <= floor:
                done = True
                break
            if lower is None or number < lower:
                yield number, doc
                upper, lower, left = number if upper is None else upper, number, left - 1
        done = done or (not found and lower is not None)
        if not found:
            break
    yield upper, lower, done


def stalest(spark: SparkSession, marks: DataFrame, channels: list[str], most: int) -> DataFrame:
    """The channels of the next run with their marks: never read ones, then by the run that read them last; ties by name."""
    known = spark.createDataFrame([(c,) for c in channels], "channel string").join(marks, "channel", "left")
    return known.orderBy(F.col("turn").asc_nulls_first(), "channel").limit(most)


def run(spark: SparkSession, store: Store, options: dict[str, str], channels: int = 100, documents: int = 1000, page: int = 100, floor: int = 0, lease: Lease | None = None) -> int:
    """One run, committed: the number of its version. Documents are appended to table `documents` (channel, number and RAW_DOCUMENT), marks replaced."""
    ship(spark)
    base = store.version()
    marks = store.read("marks", MARKS, base)
    picked = stalest(spark, marks, _made(options).channels(), channels)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _made(options)
        names = ["channel", "number", "document", "upper", "lower", "done", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for b in batches:
            for channel, upper, lower, done in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    *found, ends = read_channel(source, channel, upper, lower, bool(done), documents, page, floor)
                    rows = [(channel, n, json.dumps(d, default=str), None, None, None, None) for n, d in found] + [(channel, None, None, *ends, None)]
                except Exception as e:  # one channel's failure is its own: what it gave goes, its marks stay
                    rows = [(channel, None, None, upper, lower, done, f"{type(e).__name__}: {e}"[:300])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    each = picked.select("channel", "upper", "lower", "done").repartition(max(1, min(channels, spark.sparkContext.defaultParallelism)), "channel")
    found = written(each.mapInArrow(fetch, _FOUND), "pages")  # read once: what is committed is one reading
    docs = found.where("document is not null").select("channel", "number", F.from_json("document", RAW_DOCUMENT).alias("d")).select("channel", "number", "d.*")
    after = found.where("document is null").select("channel", "upper", "lower", F.coalesce("done", F.lit(False)).alias("done"), F.lit(base + 1).cast("bigint").alias("turn"), "error")
    kept = marks.join(after.select("channel"), "channel", "left_anti").select(after.columns).unionByName(after)
    return store.commit(base, {"documents": docs}, {"marks": kept}, lease=lease)
