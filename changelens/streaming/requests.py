"""Runs per pull request from a stream of events, with keyed state and timers.

Every event of a run kind comes to exactly one outcome:

* `repeat`: its id was seen before, however long ago within `remember`;
* `late`: a run of the request has already started from a newer event;
* `superseded`: a newer event of the request came before a run started;
* `run`: the newest event of its request, once no newer one has arrived for `pause`.

State is kept per (repo, pr_id): the ids seen, the pending event and the time of the event
that last started a run. A call to the state costs far more than an event, so ids lie in
buckets, and a bucket is read and written once per `ROUND` events of a request; with the
buckets that a batch has added to, ids are forgotten without going through the others. The clock is the time of arrival: the time of the micro-batch,
which the offset log holds, so a replayed batch sees the same one. The watermark runs on
it and drops no event, whatever time the event itself carries. Timers on it end pauses and
forget ids.

Each micro-batch replaces its own folders, named by the batch id, so a batch that is
replayed after a crash changes nothing. Events of one request in one micro-batch are put
in order of their times, `ROUND` of them at a time.

Checkpoints of versions that kept one entry per id (`seen`) can't be continued: the ids in
them are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from changelens.functions import fixed

KEYS = ["repo", "pr_id"]
OUTCOME = "repo STRING, pr_id BIGINT, event_id STRING, ts_us BIGINT, kind STRING, outcome STRING"
STORE = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 256  # of the ids of a request
ROUND = 250_000  # events of a request that a task holds at once
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Timing:
    """pause: arrival time without a newer event after which a run starts; remember: arrival
    time for which ids are kept."""

    pause: timedelta = timedelta(minutes=5)
    remember: timedelta = timedelta(days=30)


def _ms(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def _bucket(event_id: str | None) -> int:
    return crc32((event_id or "").encode()) % BUCKETS


def _rounds(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of a request, put together to about `ROUND` rows."""
    held, n = [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        if n >= ROUND:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


class RunRequests(StatefulProcessor):
    """State and timers of one request."""

    def __init__(self, timing: Timing) -> None:
        self.timing = timing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "bucket INT", "event_ids ARRAY<STRING>, at ARRAY<BIGINT>")
        self.arrivals = handle.getMapState("arrivals", "at BIGINT", "buckets ARRAY<INT>")
        self.pending = handle.getValueState("pending", "event_id STRING, ts_us BIGINT, kind STRING, due BIGINT")
        self.started = handle.getValueState("started", "ts_us BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        started = self.started.get()[0] if self.started.exists() else None
        pending = tuple(self.pending.get())[:3] if self.pending.exists() else None
        arrived, touched = None, set()
        for chunk in _rounds(rows):
            found = []
            events = chunk.sort_values(["ts_us", "event_id"])
            names, arrived = events["event_id"].tolist(), int(events["arrived_ms"].iloc[-1])
            repeats = self._repeats(names, arrived, touched)
            for *row, repeat in zip(names, events["ts_us"].tolist(), events["kind"].tolist(), repeats):
                if repeat:
                    found.append((*row, "repeat"))
                elif started is not None and row[1] < started:
                    found.append((*row, "late"))
                elif pending is not None and (row[1], row[0]) < (pending[1], pending[0]):
                    found.append((*row, "superseded"))
                else:
                    if pending is not None:
                        found.append((*pending, "superseded"))
                    pending = row
            yield self._rows(key, found)
        if pending is not None and arrived is not None:
            due = arrived + _ms(self.timing.pause)
            self.pending.update((*pending, due))
            self.handle.registerTimer(due)
        if arrived is not None:
            self.handle.registerTimer(arrived + _ms(self.timing.remember))
        if touched:
            before = self.arrivals.getValue((arrived,))
            self.arrivals.updateValue((arrived,), (sorted(touched.union(before[0] if before else ())),))

    def _repeats(self, names: list[str | None], arrived: int, touched: set[int]) -> list[bool]:
        """Whether each id was seen before; those that were not are added, their buckets to `touched`."""
        places: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            places.setdefault(_bucket(name), []).append(i)
        repeats = [False] * len(names)
        for bucket, mine in places.items():
            seen = self._seen(bucket)
            before = len(seen)
            for i in mine:
                repeats[i] = names[i] in seen
                seen.setdefault(names[i], arrived)
            if len(seen) > before:
                self._keep(bucket, seen)
                touched.add(bucket)
        return repeats

    def _seen(self, bucket: int) -> dict[str | None, int]:
        """The ids of a bucket and their times of arrival."""
        value = self.ids.getValue((bucket,))
        return dict(zip(*value)) if value else {}

    def _keep(self, bucket: int, seen: dict[str | None, int]) -> None:
        self.ids.updateValue((bucket,), (list(seen), list(seen.values())))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.pending.exists():
            *row, due = self.pending.get()
            if due <= now:  # a newer event has set a later timer otherwise
                self.pending.clear()
                self.started.update((row[1],))
                yield self._rows(key, [(*row, "run")])
        self._forget(now - _ms(self.timing.remember))

    def _forget(self, last: int) -> None:
        """Drop the ids that arrived at `last` or before."""
        old = [at for (at,) in self.arrivals.keys() if at <= last]
        for bucket in sorted({b for at in old for b in self.arrivals.getValue((at,))[0]}):
            kept = {name: at for name, at in self._seen(bucket).items() if at > last}
            if kept:
                self._keep(bucket, kept)
            else:
                self.ids.removeKey((bucket,))
        for at in old:
            self.arrivals.removeKey((at,))

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key: Any, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], key[1], *row) for row in found], columns=["repo", "pr_id", "event_id", "ts_us", "kind", "outcome"]
        )


def outcomes(events: DataFrame, timing: Timing | None = None, kinds: tuple[str, ...] = fixed.RUN_EVENT_KINDS) -> DataFrame:
    """One row per event (repo, pr_id, event_id, ts, kind) of a run kind, with its outcome."""
    arrived = F.current_timestamp()
    rows = events.where(F.col("kind").isin(*kinds)).select(
        "repo", F.col("pr_id").cast("bigint").alias("pr_id"), F.col("event_id").cast("string").alias("event_id"),
        F.unix_micros("ts").alias("ts_us"), "kind", arrived.alias("arrived"), F.unix_millis(arrived).alias("arrived_ms"),
    )
    found = (
        rows.withWatermark("arrived", "0 seconds")
        .groupBy(*KEYS)
        .transformWithStateInPandas(RunRequests(timing or Timing()), OUTCOME, "Append", "EventTime")
    )
    return found.select(*KEYS, "event_id", F.timestamp_micros("ts_us").alias("ts"), "kind", "outcome")


def start(
    events: DataFrame,
    out: str,
    checkpoint: str,
    timing: Timing | None = None,
    analyse: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Take the events through the state until the input is used up.

    Writes `outcomes`, `late` and, if `analyse` makes a table of the requests that start a
    run (repo, pr_id, event_id, ts, kind), `analysis` below `out`."""

    def save(table: DataFrame, name: str, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")

    def take(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            save(kept, "outcomes", number)
            save(kept.where("outcome = 'late'"), "late", number)
            if analyse:
                runs = kept.where("outcome = 'run'").drop("outcome").persist()
                try:
                    runs.count()  # its size is known from here on: few requests are broadcast, none cost nothing
                    save(analyse(runs), "analysis", number)
                finally:
                    runs.unpersist()
        finally:
            kept.unpersist()

    conf = events.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        writer = outcomes(events, timing).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(STORE, before)
