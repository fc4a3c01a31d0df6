"""Helpers shared by the corpus operators: shared scratch space, row maps, input tables."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship, table  # noqa: F401  (table: for the queries)


#: Paths that scratch() gave, in their order.
_MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    ship(spark)
    _MADE.append(f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def kept_only(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What make gives, written to the shared folder and read back; the tables that were written on the way are deleted."""
    before = len(_MADE)
    out = written(make(), what)
    for path in _MADE[before:-1]:
        delete(spark, path)
    del _MADE[before:-1]
    return out


#: Removes a query's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: the rows, written to the shared folder and read back. The write's shuffle files go when it has ended."""
    spark = ship(df.sparkSession)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path := scratch(spark, what))
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a Python worker gets at once, and Spark's own number of them.
BATCH_ROWS = 1_000
BATCH_KEY, BATCH_STOCK = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python workers get BATCH_ROWS rows at once, unless it has a number of its own.

    A worker keeps its last batch of texts while it is idle, and a task of the next stage may start another worker beside it. Plans
    are made when their rows are asked for, so the setting stays.
    """
    if spark.conf.get(BATCH_KEY) == BATCH_STOCK:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


@contextlib.contextmanager
def smaller_batches(spark: SparkSession) -> Iterator[None]:
    """small_batches for rows that are asked for within; then the session has its number again."""
    before = spark.conf.get(BATCH_KEY)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def give_back() -> None:
    """Returns freed memory to the system: Python workers are kept, and later stages need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def append_columns(df: DataFrame, inputs: list[str], fn: Callable[..., pa.StructArray], fields: str) -> DataFrame:
    """df with the struct fields that fn makes from the input columns; its own columns stay in the JVM.

    Columns of df with the name of a new field are replaced (names compare as Spark compares them).
    """
    ship(df.sparkSession)

    @functools.wraps(fn)
    def run(*columns: pa.Array) -> pa.Array:
        try:
            return fn(*columns)
        finally:
            give_back()

    out = F.arrow_udf(run, fields)
    new = [f.name for f in T._parse_datatype_string(fields).fields]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    inner = [f"c{i}" for i in range(len(kept))]
    made = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], out(*[F.col(f"`{c}`") for c in inputs]).alias("made"))
    return made.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], *[F.col("made").getField(n).alias(n) for n in new])


def own_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., which clash with no operator's, and the place of each name: for operators that give df's columns back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


#: Rows of one key in one task, above which a key is hot, and hot keys in one broadcast.
HOT_ROWS = 100_000
HOT_KEYS = 100_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with facts, which has one row a key with how many of rows have it (weight), so that no task gets a hot key's rows.

    Facts of keys of more than hot_rows rows are broadcast and their rows stay where they are; where rows are very many, the border
    rises with them, so that there are never more than HOT_KEYS. All other rows meet their facts in a shuffle. facts is read more than once.
    """
    total, most = facts.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).head()
    border = max(hot_rows, total // HOT_KEYS)
    if most <= border:
        return rows.join(facts, key)
    hot = facts.where(F.col(weight) > border)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(weight) <= border), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def upload(uri: str, data: bytes) -> None:
    """Writes a whole file under a Hadoop-style URI or a path: to a temporary name, then renamed, so a repeated task is harmless."""
    import os

    if "://" not in uri or uri.startswith("file:"):
        path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(tmp := f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp", "wb") as f:
            f.write(data)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(tmp := f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    store.move(tmp, path)


def fetch(uri: str) -> bytes:
    """A whole file that upload() wrote."""
    if "://" not in uri or uri.startswith("file:"):
        with open("/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()
