"""The live tail of an event log: a view of each run that is brought up to date with every batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.publishing import PHASE_NAMES, PHASES
from ..session import ship

#: Events that end a run.
ENDS = ("run.completed", "run.failed")


def after(events: DataFrame, number: int) -> DataFrame:
    """Replay: the events after a number that a reader has seen."""
    return events.where(F.col("seq") > number)


def live_views(events: DataFrame, key: str, at: str | None = None, delay: str = "1 hour", expires_ms: int | None = None) -> DataFrame:
    """key, last_seq and phase of each run that a batch changed, of a stream of events (key, seq, event): publishing.run_views() of all events so far, however
    they are cut into batches, and also where they come again or late.

    State is four values a run: the last number, the furthest phase, and the end with the smallest number, which absorbs what comes after. With expires_ms and the column `at` (event
    time, late by `delay` at most), a run without an event for so long is dropped, and told as expired if it hadn't ended.
    """
    ship(events.sparkSession)
    kind = dict(events.dtypes)[key]
    timed = expires_ms is not None and at is not None
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("event"))
    rows = (events.withWatermark(at, delay) if timed else events).select(key, "seq", rank.alias("rank"), "event", *([at] if timed else []))

    def fold(own: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, furthest, end_seq, end = state.get if state.exists else (None, 0, None, None)
        if state.hasTimedOut:
            state.remove()
            if end is None:
                yield pd.DataFrame({key: [own[0]], "last_seq": [last], "phase": ["expired"]})
            return
        before, newest = (last, furthest, end), None
        for f in frames:
            last = int(f["seq"].max()) if last is None else max(last, int(f["seq"].max()))
            furthest = int(max(furthest, f["rank"].fillna(0).max()))
            for seq, event in f.loc[f["event"].isin(ENDS), ["seq", "event"]].itertuples(index=False):
                if end_seq is None or seq < end_seq:
                    end_seq, end = int(seq), event
            if timed:
                newest = max(filter(None, (newest, f[at].max())))
        state.update((last, furthest, end_seq, end))
        if timed:
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + expires_ms, state.getCurrentWatermarkMs() + 1))
        if (last, furthest, end) != before:
            yield pd.DataFrame({key: [own[0]], "last_seq": [last], "phase": ["failed" if end == "run.failed" else PHASE_NAMES[furthest]]})

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, last_seq bigint, phase string", "last bigint, furthest int, end_seq bigint, end_event string", "update", timeout)


def views_available(views: DataFrame, key: str, folder: str, checkpoint: str) -> DataFrame:
    """The last view of each run of what is there now. Each batch's changes are written under its number; a batch that is repeated takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    views.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told = views.sparkSession.read.schema(f"{key} {dict(views.dtypes)[key]}, last_seq bigint, phase string, batch int").parquet(folder)
    return told.groupBy(key).agg(F.max_by(F.struct("last_seq", "phase"), "batch").alias("v")).select(key, "v.*")
