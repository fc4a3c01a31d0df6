"""Operators on keys: latest and best rows, merges of a batch into a table, numbering, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group. Spark cuts each map task's groups to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns, by an aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """table and the batch's first row of each key that table hasn't."""
    fresh = top_per_group(batch, keys, order, 1, "__rn").drop("__rn").join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh)


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """table with the batch's rows in place of its own; keep_old: a null of the batch keeps the table's value."""
    rest = [c for c in table.columns if c not in keys]
    both = table.alias("t").join(batch.withColumn("__new", F.lit(True)).alias("b"), keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")) if keep_old else F.when(F.col("b.__new"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def additive_upsert(table: DataFrame, batch: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of both, added by key. One aggregate: nothing is joined."""
    return table.select(*keys, *counters).unionByName(batch.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def next_ordinals(existing: DataFrame, batch: DataFrame, key: str, seq: str, order: list[Column], cap: int) -> DataFrame:
    """The batch's rows with numbers that go on after each key's largest, without those beyond the cap."""
    last = existing.groupBy(key).agg(F.max(seq).alias("__last"))
    numbered = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(last, key, "left")
    return numbered.withColumn(seq, (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("bigint")).where(F.col(seq) <= cap).drop("__n", "__last")


def redact(df: DataFrame, at: str, columns: list[str], as_of: Column, days: int, mark: str = "[deleted]") -> DataFrame:
    """Columns of rows older than so many days hold the mark."""
    old = F.col(at) < as_of - F.make_dt_interval(F.lit(days))
    return df.withColumns({c: F.when(old, F.lit(mark)).otherwise(F.col(c)) for c in columns})


def repoint(edges: DataFrame, mapping: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges with merged ends (mapping: from_id, into_id), each once, without loops."""
    m = mapping.select("from_id", "into_id")
    a = edges.join(m.select(F.col("from_id").alias(source), F.col("into_id").alias("__s")), source, "left").withColumn(source, F.coalesce("__s", source)).drop("__s")
    b = a.join(m.select(F.col("from_id").alias(target), F.col("into_id").alias("__t")), target, "left").withColumn(target, F.coalesce("__t", target)).drop("__t")
    return b.where(F.col(source) != F.col(target)).select(*edges.columns).distinct()


def orphans(nodes: DataFrame, key: str, *uses: tuple[DataFrame, str]) -> DataFrame:
    """Nodes that no table uses."""
    for df, column in uses:
        nodes = nodes.join(df.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return nodes


def untraceable(claims: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """Claims without a source: empty if the table keeps its invariant."""
    return claims.join(bridge.select(key), key, "left_anti")


def last_state(events: DataFrame, key: str, state: str, order: list[str], terminal: list[str]) -> DataFrame:
    """The state of each key after its ordered events; a terminal one stays, whatever comes after."""
    first_end = F.min(F.when(F.col(state).isin(terminal), F.struct(*order, state)))
    return events.groupBy(key).agg(F.coalesce(first_end.getField(state), F.max_by(state, F.struct(*order))).alias(state))


def compare_and_set(state: DataFrame, attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """state (key, owner, expires) after attempts (key, owner, at, until), one of each key: an attempt takes what is free, its own, or has
    run out by then; taken tells whether it did. Of a batch's attempts on one key the first by order counts."""
    first = top_per_group(attempts, [key], [F.col(c) for c in order], 1, "__rn").drop("__rn").withColumnsRenamed({"owner": "__owner"})
    both = state.join(first, key, "full_outer")
    free = F.col("owner").isNull() | (F.col("owner") == F.col("__owner")) | (F.col("expires") <= F.col("at"))
    taken = F.coalesce(F.col("__owner").isNotNull() & free, F.lit(False))
    return both.select(key, F.when(taken, F.col("__owner")).otherwise(F.col("owner")).alias("owner"), F.when(taken, F.col("until")).otherwise(F.col("expires")).alias("expires"), taken.alias("taken"))


def advanced(marks: DataFrame, proposals: DataFrame, key: str, mark: str) -> DataFrame:
    """Marks that proposals move on, never back; a key's first proposal makes its mark."""
    both = marks.select(key, mark).unionByName(proposals.select(key, mark))
    return both.groupBy(key).agg(F.max(mark).alias(mark))


def append_and_latest(log: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The log with a batch appended, and of each key the latest row of both: two results of one step, each its own write."""
    whole = log.unionByName(batch)
    return whole, latest_per_key(whole, keys, order)


def settled(events: DataFrame, key: str, state: str, at: str, as_of: Column, expires_after: Column, steps: dict[str, tuple[str, ...]], first: str) -> DataFrame:
    """key and state of ledgers after their ordered events: an event counts only where the state before it allows it (steps: state to
    those that it may follow), and a first state that is older than expires_after by as_of is expired."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(state).alias("s"))))
    allowed = F.lit(False)

    def move(now: Column, e: Column) -> Column:
        ok = allowed
        for to, since in steps.items():
            ok = ok | ((e.getField("s") == to) & now.getField("s").isin(*since))
        start = now.getField("s").isNull() & (e.getField("s") == first)
        return F.when(start | F.coalesce(ok, F.lit(False)), F.struct(e.getField("at").alias("at"), e.getField("s").alias("s"))).otherwise(now)

    none = events.schema
    empty = F.struct(F.lit(None).cast(none[at].dataType).alias("at"), F.lit(None).cast("string").alias("s"))
    folded = events.groupBy(key).agg(F.aggregate(ordered, empty, move).alias("f"))
    late = (F.col("f.s") == first) & (F.col("f.at") < as_of - expires_after)
    return folded.select(key, F.when(late, F.lit("expired")).otherwise(F.col("f.s")).alias(state))


def overwrite(df: DataFrame, path: str) -> None:
    """A full recompute in place of the table at a path."""
    df.write.mode("overwrite").parquet(path)
