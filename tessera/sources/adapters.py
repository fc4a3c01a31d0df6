"""Adapters of documents as a Spark data source: batches, and streams that keep a mark for each channel.

An adapter names its channels and gives a channel's documents after a number; numbers go up. It runs where Spark puts the channel's partition.
Offsets are marks for each channel, in the query's checkpoint: they move on only once a batch is committed.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .raw_documents import RAW_DOCUMENT


class Adapter(Protocol):
    def channels(self) -> list[str]:
        """What can be read apart."""

    def newest(self, channel: str) -> int:
        """The number of the channel's last document; 0 without any."""

    def fetch(self, channel: str, after: int, upto: int) -> Iterator[dict]:
        """The channel's documents after a number, up to another: columns of RAW_DOCUMENT by name."""


class Fixture:
    """An adapter over literal documents: {channel: [[number, content], ...]}."""

    def __init__(self, options: dict[str, str]):
        self.rows = json.loads(options["fixture"])

    def channels(self) -> list[str]:
        return sorted(self.rows)

    def newest(self, channel: str) -> int:
        return max((n for n, _ in self.rows[channel]), default=0)

    def fetch(self, channel: str, after: int, upto: int) -> Iterator[dict]:
        for n, content in self.rows[channel]:
            if after < n <= upto:
                yield {"adapter": "fixture", "external_id": f"{channel}/{n}", "content": content}


def _adapter(options: dict[str, str]) -> Adapter:
    module, _, name = options["adapter"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Channel(InputPartition):
    def __init__(self, channel: str, after: int, upto: int):
        super().__init__((channel, after, upto))


def _rows(options: dict[str, str], part: InputPartition) -> Iterator[tuple]:
    for doc in _adapter(options).fetch(*part.value):
        yield tuple(doc.get(f.name) for f in RAW_DOCUMENT)


class AdapterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Channel]:
        a = _adapter(self.options)
        return [Channel(c, 0, a.newest(c)) for c in a.channels()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.options, partition)


class AdapterStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"marks": "{}"}

    def latestOffset(self) -> dict:
        a = _adapter(self.options)
        return {"marks": json.dumps({c: a.newest(c) for c in a.channels()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Channel]:
        before, upto = json.loads(start["marks"]), json.loads(end["marks"])
        return [Channel(c, before.get(c, 0), n) for c, n in sorted(upto.items()) if n > before.get(c, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.options, partition)


class AdapterSource(DataSource):
    """Format raw_documents; option adapter: module:Class, made from the options."""

    @classmethod
    def name(cls) -> str:
        return "raw_documents"

    def schema(self) -> StructType:
        return RAW_DOCUMENT

    def reader(self, schema: StructType) -> AdapterReader:
        return AdapterReader(dict(self.options))

    def streamReader(self, schema: StructType) -> AdapterStream:
        return AdapterStream(dict(self.options))
