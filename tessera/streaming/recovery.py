"""What keeps incremental ingestion whole: schedules, days that are made again, gap backfills with checkpoints, catching up, health."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .commits import Conflict, Lease, Store


def scheduled(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """A writer's trigger: by processing time, or once over what is there."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def open_days(now: datetime, final_hour: int = 2) -> list[tuple[date, bool]]:
    """The days that a run makes again, each with whether it is final: today, and yesterday, which is final from an hour of the next day on."""
    return [(now.date() - timedelta(days=1), now.hour >= final_hour), (now.date(), False)]


def rolling_counts(stream: DataFrame, at: str, keys: Sequence[str], size: str = "24 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of rolling windows; rows come late by up to a day."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def roster_hash(names: Sequence[str]) -> str:
    """What a roster is known by; its order counts, since batches are cut from it."""
    return hashlib.sha256("\n".join(n.lower() for n in names).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Backfill:
    """Where the backfill of a gap is: the next batch and its cursor."""

    first: int
    last: int
    roster: str
    batch_size: int
    accounts: int
    batch: int = 0
    cursor: str = ""
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def batches(self) -> int:
        return -(-self.accounts // self.batch_size)

    @property
    def complete(self) -> bool:
        return self.batch >= self.batches

    def refusal(self, first: int, last: int, names: Sequence[str], batch_size: int) -> str | None:
        """Why this can't go on with other arguments: batches would be other ones."""
        if (first, last) != (self.first, self.last):
            return "range"
        if roster_hash(names) != self.roster:
            return "roster"
        return "batch size" if batch_size != self.batch_size else None

    def after(self, page_cursor: str, **counted: int) -> Backfill:
        """After a page was stored: its cursor, or the next batch where there is none."""
        counts = {k: self.counts.get(k, 0) + counted.get(k, 0) for k in {*self.counts, *counted}}
        return replace(self, cursor=page_cursor, counts=counts) if page_cursor else replace(self, batch=self.batch + 1, cursor="", counts=counts)


def backfill(first: int, last: int, names: Sequence[str], batch_size: int) -> Backfill:
    return Backfill(first, last, roster_hash(names), batch_size, len(names))


def continue_backfill(
    store: Store, page: Callable[[Sequence[str], str], tuple[DataFrame, str]], first: int, last: int, names: Sequence[str], batch_size: int, most: int, lease: Lease | None = None
) -> Backfill:
    """Goes on with the backfill that a store keeps, or begins one: at most so many pages. Where it is then.

    page gives the documents of some names after a cursor ("" at first) and the next cursor ("" at the end). A page's documents and the checkpoint after it are one
    commit, so a run that ends anywhere loses and repeats nothing. Other arguments than the kept ones are refused (ValueError) until it is complete.
    """
    version = store.version()
    kept = store.manifest(version)["about"].get("backfill")
    now = Backfill(**kept) if kept else backfill(first, last, names, batch_size)
    refused = now.refusal(first, last, names, batch_size)
    if refused and not now.complete:
        raise ValueError(f"another {refused} is being backfilled")
    now = backfill(first, last, names, batch_size) if refused else now
    while most > 0 and not now.complete:
        docs, cursor = page(names[now.batch * batch_size : (now.batch + 1) * batch_size], now.cursor)
        after = now.after(cursor, pages=1)
        version = store.commit(version, {"documents": docs}, about={"backfill": asdict(after)}, lease=lease)
        now, most = after, most - 1
    return now


def advance(store: Store, name: str, seen: datetime | None, to: datetime, lease: Lease | None = None) -> datetime | None:
    """Moves a kept watermark to a catch-up's end, if it still is the one that was seen, and never back: what it is then. Other writers' commits in between are no conflict
    unless they moved it."""
    while True:
        version = store.version()
        marks = store.manifest(version)["about"].get("watermarks", {})
        now = datetime.fromisoformat(marks[name]) if name in marks else None
        then = caught_up(now, seen, to)
        if then == now:
            return now
        try:
            store.commit(version, about={"watermarks": marks | {name: then.isoformat()}}, lease=lease)
            return then
        except Conflict:
            if lease is not None and not lease.holds(store.spark):
                raise


def parked(watermark: datetime | None, now: datetime, after: timedelta) -> bool:
    """Whether a watermark has stood still for so long that catching up is due."""
    return watermark is not None and now - watermark > after


def caught_up(watermark: datetime | None, seen: datetime | None, to: datetime) -> datetime | None:
    """The watermark after a catch-up to `to`: moved only if it is still the one that was seen, and never back."""
    return watermark if watermark != seen else to if watermark is None else max(watermark, to)


def episodes(runs: DataFrame, key: str, at: str, problem: str, cooldown: Column) -> DataFrame:
    """key, at, fire (unhealthy, recovery or null) of runs with their problem (null: healthy): an episode of one problem tells once, and again
    after the cooldown; its end tells once. Runs without effect are left out by the caller.

    A run is compared with the one before; how often a long episode tells hangs on when it told last, so each episode is folded by itself.
    """
    w = Window.partitionBy(key).orderBy(at)
    before = F.lag(F.coalesce(problem, F.lit(""))).over(w)
    now = F.coalesce(problem, F.lit(""))
    turned = F.when(before.isNull() | (before != now), 1).otherwise(0)
    marked = runs.withColumns({"__new": turned, "__before": F.coalesce(before, F.lit(""))}).withColumn("__e", F.sum("__new").over(w))
    times = F.array_sort(F.collect_list(F.col(at)))

    def tell(told: Column, t: Column) -> Column:
        due = (F.size(told) == 0) | (t >= F.element_at(told, -1) + cooldown)
        return F.when(due, F.concat(told, F.array(t))).otherwise(told)

    kind = dict(runs.dtypes)[at]
    told = marked.where(F.col(problem).isNotNull()).groupBy(key, "__e").agg(F.aggregate(times, F.array().cast(f"array<{kind}>"), tell).alias("__told"))
    found = marked.join(told, [key, "__e"], "left")
    fire = F.when(F.col(problem).isNotNull() & F.array_contains("__told", F.col(at)), "unhealthy").when(F.col(problem).isNull() & (F.col("__new") == 1) & (F.col("__before") != ""), "recovery")
    return found.select(key, at, problem, fire.alias("fire"))
