"""Deterministic samples, and numbers in the order of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def numbered(df: DataFrame, order: str, name: str = "n", start: int = 0) -> DataFrame:
    """df with the place of each row in the order of a unique column, from start on; nulls come first.

    Rows are range-partitioned, numbered in their task and written with the task's number. Then starts come from the counts of the tasks
    before: one number a task reaches the driver, and no task sees all rows. The written rows are counted, as partitions of the same plan
    may be cut in another way when it runs again.
    """
    own = F.monotonically_increasing_id()  # the task's number, then the row's place in it
    placed = df.repartitionByRange(F.asc_nulls_first(order)).sortWithinPartitions(F.asc_nulls_first(order))
    rows = written(placed.withColumn("__task", F.shiftright(own, 33)).withColumn("__at", own.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    starts, total = [], start
    for r in sorted(rows.groupBy("__task").count().collect(), key=lambda r: r["__task"]):
        starts += [F.lit(r["__task"]), F.lit(total)]
        total += r["count"]
    base = F.element_at(F.create_map(*starts), F.col("__task")) if starts else F.lit(0)
    return rows.withColumn(name, (base + F.col("__at")).cast("bigint")).drop("__task", "__at")


def every_nth(df: DataFrame, order: str, step: int) -> DataFrame:
    """Rows 0, step, 2 * step ... in the order of a unique column."""
    return numbered(df, order, "__n").where(F.col("__n") % step == 0).drop("__n")


def get_or_create(known: DataFrame, keys: DataFrame, key: str, number: str) -> DataFrame:
    """key and number of each different key: the known one's, or the next free ones in the order of new keys."""
    asked = keys.select(key).distinct()
    last = known.agg(F.coalesce(F.max(number), F.lit(0))).head()[0]
    fresh = numbered(asked.join(known.select(key), key, "left_anti"), key, number, last + 1)
    return known.join(asked, key, "left_semi").select(key, number).unionByName(fresh.select(key, number))


def turns_without_copies(df: DataFrame, stratum: str, part: str, order: list[Column], copies: str, most: int) -> DataFrame:
    """turn and df's columns of the rows that are taken by turns of strata, in their order, and in a stratum by turns of its parts.

    A part gives its first row (by order) whose value of `copies` was taken nowhere yet; parts that have none are passed over, and so are strata; the
    stratum's next turn starts at the part after the one that gave. All ends with `most` rows, or with a turn in which no stratum gives.

    What a stratum gives is known until one of the strata before it in the same turn takes its value. So a job finds the next row of every stratum at once, and those
    up to the first such conflict count: jobs are turns and conflicts, `most` at the worst. The driver sees `most` rows a job. Null strata and parts count as empty ones, null values of `copies` as one value.
    """
    spark, keys = df.sparkSession, [f"__{n}" for n in ("s", "p", "n", "o", "c", "r")]
    parts = F.dense_rank().over(Window.partitionBy("__s").orderBy("__p"))
    rows = df.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__s"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__p"), F.row_number().over(Window.partitionBy(stratum, part).orderBy(*order)).alias("__o"), F.coalesce(F.col(copies).cast("string"), F.lit("")).alias("__c"), F.struct(*df.columns).alias("__r"))
    # of one value, a part can only give its first row
    first = F.row_number().over(Window.partitionBy("__s", "__p", "__c").orderBy("__o"))
    rows = rows.withColumn("__first", first).where("__first = 1").withColumn("__i", parts - 1).drop("__first")
    rows = written(rows.withColumn("__n", F.max("__i").over(Window.partitionBy("__s")) + 1).select("__i", *keys), "turns")
    taken: list[tuple] = []
    seen, following, turn, at, gave = set(), {}, 0, None, False
    while len(taken) < most:
        left = rows if at is None else rows.where(F.col("__s") > at)
        if seen:
            left = left.where(~F.col("__c").isin(sorted(seen)))
        turns = F.coalesce(*[F.when(F.col("__s") == s, F.lit(i)) for s, i in following.items()], F.lit(0))
        way = F.pmod(F.col("__i") - turns, F.col("__n"))
        nexts = left.groupBy("__s").agg(F.min_by(F.struct("__i", "__n", "__c", "__r"), F.struct(way, "__o")).alias("m")).orderBy("__s").limit(most - len(taken)).collect()
        conflict = False
        for r in nexts:
            if r.m["__c"] in seen:
                conflict = True
                break
            seen.add(r.m["__c"])
            following[r["__s"]] = (r.m["__i"] + 1) % r.m["__n"]
            taken.append((turn, r.m["__r"]))
            at, gave = r["__s"], True
        if conflict or len(taken) >= most:
            continue
        if not gave:
            break
        turn, at, gave = turn + 1, None, False
    return spark.createDataFrame([(t, *r) for t, r in taken], T.StructType([T.StructField("turn", T.IntegerType()), *df.schema.fields]))


def by_turns(df: DataFrame, stratum: str, part: str, order: list[Column], most: int) -> DataFrame:
    """The first rows by turns of strata, and in a stratum by turns of its parts; a part's rows in their order."""
    own = df.withColumn("__i", F.row_number().over(Window.partitionBy(stratum, part).orderBy(*order))).where(F.col("__i") <= most)
    ranked = own.withColumn("__j", F.row_number().over(Window.partitionBy(stratum).orderBy("__i", part))).where(F.col("__j") <= most)
    return ranked.orderBy("__j", stratum).limit(most).drop("__i", "__j")
