"""Triage streams.

Watermarks need TIMESTAMP columns in UTC. Rows later than the watermark are dropped, which the
batch twins don't do: they see all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from docketry.operators.windows import latest
from docketry.sources.manifest import Manifest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a level of a table of latest rows that are merged into one of the next level.
FANOUT = 4


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB, for streams that are started from now on: it may be larger than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def dedupe_submissions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each submission_id; a repeat that comes later than the delay is not caught."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["submission_id"])


def first_submissions(rows: DataFrame) -> DataFrame:
    """Batch twin of dedupe_submissions: which of the repeats stays is free, so only the ids compare."""
    return rows.dropDuplicates(["submission_id"])


class Progress(StatefulProcessor):
    """The items of a batch that are in, until all are.

    State: the items, in as many rows as keep each to some BUCKET of them, and a row that tells how many there are, whether
    the closing row went out, the last time seen and when the timer goes off. So a micro-batch reads and writes each row of
    state that it touches once, however many results it brings. The timer is set once and moves on when it goes off too
    early; at the last time seen it removes it all: once the watermark has passed it, any repeat is late and dropped.
    """

    BUCKET = 64

    def __init__(self, expected: int, patience_ms: int):
        self.expected, self.patience = expected, patience_ms
        self.buckets = max(1, -(-expected // self.BUCKET))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "bucket int", "seen array<string>")
        self.told = handle.getValueState("told", "done long, closed boolean, last long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        done, closed, last, due = self.told.get() or (0, False, 0, None)
        before, was = done, (closed, last)
        new: dict[int, set[str]] = {}
        for row in rows:
            last = max(last, int(row["ms"]))
            # a null item is none; after closing all repeats are ignored
            if not closed and row["item"] is not None:
                new.setdefault(crc32(row["item"].encode("utf-8", "surrogatepass")) % self.buckets, set()).add(row["item"])
        for bucket, items in new.items():
            held = list((before and self.items.getValue((bucket,)) or [[]])[0])
            fresh = items.difference(held)
            if fresh:
                self.items.updateValue((bucket,), ([*held, *sorted(fresh)],))
                done += len(fresh)
        if not closed and done >= self.expected:
            closed = True
            self.items.clear()  # what is left is a line that says that the batch is closed
        if due is None or closed and not was[0]:
            if due is not None:
                self.handle.deleteTimer(due)
            due = last + (0 if closed else self.patience)
            self.handle.registerTimer(due)
        if done > before or was != (closed, last):
            self.told.update((done, closed, last, due))
        if done > before:
            yield Row(batch_id=key[0], done=done, closed=closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        done, closed, last, due = self.told.get() or (0, True, 0, 0)
        until = last + (0 if closed else self.patience)
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.told.update((done, closed, last, until))
            self.handle.registerTimer(until)
        else:
            self.items.clear()
            self.told.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_progress(results: DataFrame, expected: int, delay: str = "1 day", patience_days: int = 30) -> DataFrame:
    """(batch_id, done, closed) as results (batch_id, item, ts) come in: how many different items a batch has.

    One row a batch and micro-batch that brings new items, in append or update mode. The row with closed = true comes
    exactly once, with the expected-th item: repeats and replays after it give none. State goes once repeats would be
    late; a batch that is never complete is forgotten patience_days after its last result. Null items are none.
    """
    keep_state_on_disk(results.sparkSession)
    rows = results.withWatermark("ts", delay).select("batch_id", F.col("item").cast("string").alias("item"), "ts", F.unix_millis("ts").alias("ms"))
    schema = f"batch_id {results.schema['batch_id'].dataType.simpleString()}, done long, closed boolean"
    return rows.groupBy("batch_id").transformWithState(Progress(expected, patience_days * 86_400_000), schema, "Append", "EventTime")


def read_latest(table: Manifest, key: list[str], ts: str = "ts", tie: str = "result_id") -> DataFrame:
    """The latest row of each key of a table that stream_latest keeps."""
    return latest(table.read(), key, ts, tie)


def merge_latest(batch: DataFrame, table: Manifest, key: list[str], ts: str, tie: str) -> None:
    """One micro-batch of stream_latest: its latest rows become a part, and full levels are merged.

    A row is written once for each level, so a batch costs its own rows and a share of merges that grows with the
    logarithm of the table. A batch that is run again adds rows that are there already, and latest() takes one of them.
    """
    new = table.write(latest(batch, key, ts, tie), level=0)
    parts = [*table.parts(), new]
    table.commit(parts, batch.schema)
    level = 0
    while len(full := [p for p in parts if p["level"] == level]) >= FANOUT:
        merged = table.write(latest(table.read(full), key, ts, tie), level=level + 1)
        parts = [*[p for p in parts if p["level"] != level], merged]
        table.commit(parts, batch.schema)
        level += 1
    table.clear(versions=level + 2)


def stream_latest(results: DataFrame, path: str, key: list[str], ts: str = "ts", tie: str = "result_id") -> DataStreamWriter:
    """A writer that keeps the latest result of each key in the table at path; read it with read_latest().

    The table is its own: a stream that starts anew, with a new checkpoint, adds to it.
    """

    def merged(batch: DataFrame, epoch: int) -> None:
        merge_latest(batch, Manifest(batch.sparkSession, path), key, ts, tie)

    return results.writeStream.foreachBatch(merged)


def stream_auto_tag(results: DataFrame, authorizations: DataFrame, delay: str = "1 day", hours: int = 48) -> DataFrame:
    """Results within the hours after their batch's authorisation, as they arrive; the time bound lets state expire."""
    r = results.withWatermark("ts", delay).alias("r")
    a = authorizations.withWatermark("granted_ts", delay).alias("a")
    bound = F.expr(f"r.batch_id = a.batch_id AND r.ts >= a.granted_ts AND r.ts <= a.granted_ts + INTERVAL {hours} HOURS")
    return r.join(a, bound).select("r.*", "a.granted_ts")
