"""Settling as a live stream: a timer a directory in processing time, so that the last directory of a quiet library fires too.

Input rows are events (dir_path, path, event_type, event_time, dir_ctime, size). An event sets its directory's timer anew; a
timer that fires before the directory is old enough is set once more, for the exact remainder. Rows of type ``polled`` tell a
file's size: they leave the timer alone, and a file is stable once as many of its samples as asked for in a row are equal, or
given up after the most that are waited for. A directory that is due is let go at the sample that settles its last file. A
file that is deleted is no longer waited for; a directory without files is let go by its timer alone.

State lives in the state store: one value a directory and one map entry a file, which expire by themselves a day after they
were last touched. No window holds a directory's events, so a busy one costs what a quiet one does.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import patterns as P

#: What a stream over timers needs: the store that has them.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READY = "dir_path string, ready_at timestamp, events long, files long, stable boolean"


def millis(at: datetime | None) -> int:
    if at is None:
        return 0
    return int((at if at.tzinfo else at.astimezone(timezone.utc)).timestamp() * 1000)


class Settling(StatefulProcessor):
    """One directory: clock (events, born, when due, whether it is) and files (size, equal samples, samples)."""

    def __init__(self, quiet: float, age: float, polls: int, most_polls: int, keep: float):
        self.quiet, self.age, self.polls, self.most, self.keep = int(quiet * 1000), int(age * 1000), polls, most_polls, int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "events long, born long, timer long, due boolean", self.keep)
        self.files = handle.getMapState("files", "path string", "size long, equal int, samples int", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        events, born, timer, due = self.clock.get() if self.clock.exists() else (0, 1 << 62, 0, False)
        touched = False
        for r in rows:
            if r["event_type"] == "polled":
                self.sampled(r["path"], r["size"])
                continue
            touched, events = True, events + 1
            born = min(born, millis(r["dir_ctime"]))
            if r["event_type"] == "deleted":
                self.files.removeKey((r["path"],))
            elif self.polls and r["path"] is not None and not self.files.containsKey((r["path"],)):
                self.files.updateValue((r["path"],), (-1, 0, 0))
        if touched:
            if timer:
                self.handle.deleteTimer(timer)
            timer, due = now + self.quiet, False
            self.handle.registerTimer(timer)
        if not events:  # samples of a directory that nothing has happened to
            self.files.clear()
            return iter(())
        self.clock.update((events, born, timer, due))
        return self.let_go(key, now) if due else iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.clock.exists():
            return iter(())
        events, born, timer, _ = self.clock.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():  # set anew since
            return iter(())
        if now < born + self.age:
            timer = born + self.age
            self.handle.registerTimer(timer)
            self.clock.update((events, born, timer, False))
            return iter(())
        self.clock.update((events, born, 0, True))
        return self.let_go(key, now)

    def sampled(self, path: str, size: int | None) -> None:
        if not self.polls or path is None:
            return
        last, equal, samples = self.files.getValue((path,)) if self.files.containsKey((path,)) else (-1, 0, 0)
        equal = equal + 1 if size == last else 1
        self.files.updateValue((path,), (size if size is not None else -1, equal, samples + 1))

    def let_go(self, key: tuple, now: int) -> Iterator[Row]:
        """The directory's row, if no file of it is still waited for."""
        stable, n = True, 0
        for _, equal, samples in (self.files.values() if self.polls else ()):
            n += 1
            if equal < self.polls:
                stable = False
                if samples < self.most:
                    return iter(())
        events = self.clock.get()[0]
        self.clock.clear()
        self.files.clear()
        return iter([Row(dir_path=key[0], ready_at=datetime.fromtimestamp(now / 1000), events=events, files=n, stable=stable)])

    def close(self) -> None:
        pass


def settled(events: DataFrame, quiet: float = P.SETTLE_SECONDS, age: float = P.MIN_AGE_SECONDS, polls: int = 0, most_polls: int = P.MAX_POLLS, keep: float = 86_400) -> DataFrame:
    """(dir_path, ready_at, events, files, stable) of each directory once it is quiet, old enough and its files stable.

    polls: equal samples of its size that a file needs (0: files are not waited for); most_polls: after so many samples a file
    is given up, and its directory comes with stable false. Events without a directory are passed over.
    """
    for name, kind in (("path", "string"), ("size", "long")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    rows = events.where("dir_path is not null").select("dir_path", "path", "event_type", "dir_ctime", "size")
    return rows.groupBy("dir_path").transformWithState(Settling(quiet, age, polls, most_polls, keep), READY, "append", "processingTime")


def started(stream: DataFrame, into: str, checkpoint: str, every: float = 1.0) -> StreamingQuery:
    """Start writing a stream of settled directories as Parquet, in a store that has timers."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(processingTime=f"{int(every * 1000)} milliseconds").start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def waiting(query: StreamingQuery) -> int | None:
    """How many rows of state are left after the last batch, or None before the first."""
    last = query.lastProgress
    return sum(s.numRowsTotal for s in last.stateOperators) if last and last.stateOperators else None


def drained(query: StreamingQuery, seconds: float = 600, still: int = 2) -> None:
    """Wait until nothing is waited for in ``still`` batches one after another, then stop; for sources that end."""
    end, seen, done = time.monotonic() + seconds, -1, 0
    while query.isActive and time.monotonic() < end:
        last = query.lastProgress
        if last and last.batchId != seen:
            seen = last.batchId
            done = done + 1 if waiting(query) == 0 and last.numInputRows == 0 else 0
            if done >= still:
                break
        time.sleep(0.05)
    query.stop()
    if query.exception():
        raise query.exception()
