"""Vectors of texts that need no model, and what is still to embed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .near_duplicates import OFFSET, PRIME

#: Characters of a text that count, and texts of a request.
MOST_CHARS, REQUEST = 2000, 128
#: Fixed value: the step of the generator's state.
STEP = 0x6D2B79F5


def seeds(texts: list[str]) -> np.ndarray:
    """The FNV-1a hash of each text's UTF-16 units."""
    units = [np.frombuffer(t.encode("utf-16-le"), "<u2") for t in texts]
    size = np.array([len(u) for u in units])
    flat, starts = np.concatenate([*units, np.zeros(0, "<u2")]).astype(np.uint32), np.cumsum(size) - size
    h = np.full(len(texts), OFFSET, np.uint32)
    for at in range(int(size.max(initial=0))):
        live = np.nonzero(size > at)[0]
        h[live] = (h[live] ^ flat[starts[live] + at]) * np.uint32(PRIME)
    return h


def unit_vectors(texts: list[str], size: int) -> np.ndarray:
    """Vectors of length one that hang on nothing but the text: a generator of 32 bits, seeded by the text's hash.

    The generator's state goes on by a fixed step, so all numbers of a vector are made at once.
    """
    state = seeds(texts)[:, None] + np.arange(1, size + 1, dtype=np.uint32) * np.uint32(STEP)
    t = (state ^ state >> np.uint32(15)) * (state | np.uint32(1))
    t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
    x = (t ^ t >> np.uint32(14)) / 4294967296.0 * 2 - 1
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length == 0, 1, length)[:, None]


def embedded(df: DataFrame, text: str, size: int = 1536, to: str = "embedding") -> DataFrame:
    """df with the vector of each text's first MOST_CHARS characters; null for no text."""
    ship(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        some = texts.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(texts), size))
        for a in range(0, len(texts), REQUEST):
            part = [t[:MOST_CHARS] for t in texts[a : a + REQUEST].fill_null("").to_pylist()]
            out[a : a + REQUEST] = unit_vectors(part, size)
        ends = pa.array(np.arange(0, out.size + 1, size, dtype=np.int32), mask=np.append(~some, False))
        return pa.ListArray.from_arrays(ends, out.ravel())

    return df.withColumn(to, F.arrow_udf(run, "array<double>")(F.col(f"`{text}`")))


def missing(claims: DataFrame, vectors: DataFrame, key: str, model: Column, last: int | None = None, most: int | None = None) -> DataFrame:
    """Claims without a vector of the model, after a checkpoint's last key, in the order of keys."""
    todo = claims.join(vectors.where(model).select(key).distinct(), key, "left_anti")
    todo = todo if last is None else todo.where(F.col(key) > last)
    return todo.orderBy(key) if most is None else todo.orderBy(key).limit(most)


def moved_on(checkpoint: dict, last: int, count: int) -> dict:
    """The checkpoint after a batch; a smaller key never takes it back."""
    return {"last": max(checkpoint.get("last", 0), last), "processed": checkpoint.get("processed", 0) + count}
