"""Event logs as streams: tails beyond a cursor, triggers that fire once, reminders, gaps and stale jobs.

Streams are Structured Streaming; each run takes what is there and stops, and a checkpoint folder lets the next run go
on where this one ended, so an executor or driver that is lost costs one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftgraph.storage import shared_folder

#: State with timers needs this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files under a path as a stream of their rows."""
    schema, path = spark.read.parquet(path).schema, path.rstrip("/")
    # a pattern, as a plain path would have to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, name: str, target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream has now, written as Parquet once each, and what the target held before.

    With a target and checkpoint of the caller's own, a later call adds only what came since.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex}"
    target, checkpoint = target or f"{base}/rows", checkpoint or f"{base}/checkpoint"
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def drained_with_timers(stream: DataFrame, name: str, target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """drained() for a stream whose state has timers; the session's state store is as it was afterwards."""
    conf, (key, value) = stream.sparkSession.conf, _STORE
    before = conf.get(key, None)
    conf.set(key, value)
    try:
        return drained(stream, name, target, checkpoint)
    finally:
        conf.set(key, before) if before else conf.unset(key)


def for_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every new batch to the sink once it is whole; a batch that failed comes again with its number."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tail(events: DataFrame, cursor: int, id_: str = "event_id") -> DataFrame:
    """Rows beyond the cursor, of a table or a stream."""
    return events.where(F.col(id_) > cursor)


def fired_once(events: DataFrame, at: str, keys: list[str], zone: str = "UTC", late: str = "1 day") -> DataFrame:
    """One row (keys, minute) for each local minute in which a key has an event; a stream forgets minutes older than `late`."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    minute = F.date_format(F.from_utc_timestamp(F.date_trunc("minute", F.col(at)), zone), "yyyy-MM-dd HH:mm")
    return rows.select(*keys, F.date_trunc("minute", F.col(at)).alias("_minute"), minute.alias("minute")).dropDuplicates([*keys, "_minute"]).drop("_minute")


def fired_daily(events: DataFrame, at: str, keys: list[str], zone: str) -> DataFrame:
    """(keys, day, first): the first event of each key on each local day."""
    local = F.from_utc_timestamp(F.col(at), zone)
    return events.groupBy(*keys, F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.min(at).alias("first"))


def overdue(tasks: DataFrame, sent: DataFrame, key: str, deadline: str, now: Column) -> DataFrame:
    """Tasks whose deadline has passed and that no notice was sent for."""
    return tasks.where(F.col(deadline) < now).join(sent.select(key).distinct(), key, "left_anti")


def stale(jobs: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """Jobs to queue again: queued ones, and running ones whose heartbeat is older than `seconds` or missing."""
    old = F.coalesce(F.unix_micros(now) - F.unix_micros(F.col("heartbeat")) > seconds * 1_000_000, F.lit(True))
    return jobs.where((F.col("status") == "queued") | ((F.col("status") == "running") & old))


def gaps(events: DataFrame, key: str, at: str, grace_seconds: int, tie: str) -> DataFrame:
    """(key, at, seconds) of events that follow the one before by `grace_seconds` or more."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, tie))
    rows = events.withColumn("_gap", F.unix_micros(F.col(at)) - F.unix_micros(before))
    return rows.where(F.col("_gap") >= grace_seconds * 1_000_000).select(key, tie, F.floor(F.col("_gap") / 1_000_000).alias("seconds"))


def sessions(events: DataFrame, key: str, at: str, grace_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, n, opened, closed) of sessions of a stream that a silence of `grace_seconds` in event time ends.

    The watchdog's rule with state: a session is emitted once the watermark has passed its last event by the grace.
    Events of a batch are folded into one row of state a key; sessions that are still open stay in the state.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(state.get)] if state.exists else []
        if not state.hasTimedOut:
            times = sorted(int(t) for batch in batches for t in batch["_ms"])
            held += [(1, t, t) for t in times]
        held.sort(key=lambda x: x[1])
        out: list[tuple[int, int, int]] = []
        for n, first, last in held:
            if out and first - out[-1][2] < grace_seconds * 1000:
                out[-1] = (out[-1][0] + n, out[-1][1], max(out[-1][2], last))
            else:
                out.append((n, first, last))
        done = out if state.hasTimedOut else out[:-1]
        if state.hasTimedOut:
            state.remove()
        elif out:
            state.update(out[-1])
            state.setTimeoutTimestamp(max(out[-1][2] + grace_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame([(group[0], *x) for x in done], columns=[key, "n", "opened", "closed"])

    marked = events.withWatermark(at, late).withColumn("_ms", F.unix_millis(F.col(at)))
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, opened long, closed long", "n long, first long, last long", "append", "EventTimeTimeout")


class _Watchdog(StatefulProcessor):
    """Of one connection: events that the watermark has not passed, and what is known at the last one that it has."""

    def __init__(self, key: str, grace_ms: int, most_ms: int):
        self.key, self.grace, self.most = key, grace_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, step int")
        self.known = handle.getValueState("known", "opened long, down long, flying long, aged boolean, lost boolean")

    def _rows(self, key: tuple, found: list[tuple[str, int, int]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *x) for x in found], columns=[self.key, "reason", "opened", "due"])

    def _advanced(self, events: list[tuple[int, int, int]], now: int) -> list[tuple[str, int, int]]:
        """Takes the events in their order and gives the alarms due up to now."""
        opened, down, flying, aged, lost = self.known.get() if self.known.exists() else (-1, -1, 0, False, False)
        out: list[tuple[str, int, int]] = []

        def due(until: int) -> None:
            nonlocal aged, lost
            if down >= 0 and not lost and down + self.grace <= until:
                out.append(("disconnected", opened, down + self.grace))
                lost = True
            if opened >= 0 and not aged and flying <= 0 and opened + self.most <= until:
                out.append(("aged", opened, max(opened + self.most, since)))
                aged = True

        since = opened
        for at, _, step in events:
            due(at - 1)
            since = at
            if step == UP:
                opened, down, flying, aged, lost = at, -1, 0, False, False
            elif step == DOWN:
                down = at if down < 0 else down
            else:
                flying += step
            due(at)
        due(now)
        self.known.update((opened, down, flying, aged, lost))
        waits = [t for t, open_ in ((down + self.grace, down >= 0 and not lost), (opened + self.most, opened >= 0 and not aged and flying <= 0)) if open_]
        if waits:
            self.handle.registerTimer(min(waits))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(q), int(s)) for part in rows for t, q, s in zip(part["ms"], part["seq"], part["step"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(min(new)[0], timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        ready, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(rest[0][0])
        yield from self._rows(key, self._advanced(ready, now))

    def close(self) -> None:
        pass


#: Steps of a connection: it comes up, it goes down; +1 and -1 begin and end an answer.
UP, DOWN = 2, -2


def watchdog(events: DataFrame, key: str, at: str, step: Column, order: str, grace_seconds: int, most_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, reason, opened, due): when each connection of a stream has to be rebuilt, in milliseconds.

    `disconnected`: it went down and did not come up within the grace.  `aged`: it came up `most_seconds` ago or more and
    no answer is in flight; while one is, the alarm waits for its end.  Each reason is given once until the connection
    comes up again (a connection that was never seen up has opened = -1 and doesn't age).  step: UP, DOWN, 1 or -1;
    order: number that orders events of one millisecond.

    Events wait in the state until the watermark, `late` behind the newest event, has passed them, and are then taken in
    their order; timers wake a connection when events or alarms are due.  Run it with drained_with_timers().
    """
    kind = events.schema[key].dataType.simpleString()
    marked = events.where(step.isNotNull()).withWatermark(at, late).select(key, at, F.unix_millis(F.col(at)).alias("ms"), F.col(order).cast("long").alias("seq"), step.cast("int").alias("step"))
    processor = _Watchdog(key, grace_seconds * 1000, most_seconds * 1000)
    return marked.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, reason string, opened long, due long", "Append", "EventTime")
