"""When a directory has settled: sessions of events, the least age, polls of equal size. Batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import patterns as P
from ..operators import nesting


def archive_events(events: DataFrame) -> DataFrame:
    """Events on archives, a move counted at its destination. Adds dir_path."""
    at = F.when(F.col("event_type") == "moved", F.col("dest_path")).otherwise(F.col("path")) if "dest_path" in events.columns else F.col("path")
    out = events.withColumn("path", at).where(F.lower("path").endswith(".cbz"))
    return out.withColumn("dir_path", F.regexp_replace("path", r"/[^/]*$", ""))


def sessions(events: DataFrame, key: str, time: str, quiet: str = f"{P.SETTLE_SECONDS} seconds", late: str | None = None) -> DataFrame:
    """(key, started, settled, events): bursts of events that a quiet time ends. With ``late`` as a stream's watermark."""
    if late is not None:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "events")


def ready(settled: DataFrame, created: str, age: int = P.MIN_AGE_SECONDS) -> DataFrame:
    """Adds ready_at: settled, and at least ``age`` seconds after creation; the wait is exactly the remainder."""
    return settled.withColumn("ready_at", F.greatest("settled", F.col(created) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(age)))))


def ready_directories(events: DataFrame, late: str = "10 seconds", quiet: int = P.SETTLE_SECONDS, age: int = P.MIN_AGE_SECONDS) -> DataFrame:
    """The streaming form: (dir_path, ready_at, events) once a directory is quiet and old enough.

    events: (dir_path, event_time, dir_ctime). A timer a directory: each event sets it anew, and when it fires before the
    least age it is set once more for the remainder.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, born, n = state.get
            state.remove()
            yield pd.DataFrame({"dir_path": [key[0]], "ready_at": [pd.Timestamp(max(last + quiet * 1000, born + age * 1000), unit="ms")], "events": [n]})
            return
        last, born, n = state.get if state.exists else (0, 1 << 62, 0)
        for b in batches:
            last = max(last, int(b["event_time"].max().timestamp() * 1000))
            born = min(born, int(b["dir_ctime"].min().timestamp() * 1000))
            n += len(b)
        state.update((last, born, n))
        state.setTimeoutTimestamp(max(last + quiet * 1000, born + age * 1000, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("event_time", late)
        .groupBy("dir_path")
        .applyInPandasWithState(run, "dir_path string, ready_at timestamp, events long", "last long, born long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def stable_at(samples: DataFrame, key: str, nth: str, size: str, polls: int = P.STABLE_POLLS, most: int = P.MAX_POLLS) -> DataFrame:
    """(key, stable_at): the first sample that ends ``polls`` of equal size, within the first ``most``; null if none does."""
    w = W.partitionBy(key).orderBy(nth)
    rows = samples.withColumns({"__k": F.row_number().over(w), "__moved": (F.col(size) != F.lag(size).over(w)).cast("int")}).where(F.col("__k") <= most)
    last = W.partitionBy(key).orderBy("__k").rowsBetween(-(polls - 2), 0)
    rows = rows.withColumn("__quiet", (F.sum(F.coalesce("__moved", F.lit(1))).over(last) == 0) & (F.col("__k") >= polls))
    return rows.groupBy(key).agg(F.min(F.when(F.col("__quiet"), F.col(nth))).alias("stable_at"))


def outside(events: DataFrame, busy: DataFrame) -> DataFrame:
    """Events whose directory no directory under work equals, holds or lies in; busy: (dir_path)."""
    return nesting.apart(events, busy.select("dir_path"), "dir_path")
