"""Structured Streaming forms of the frame operators. All keep state under a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): tumbling or sliding counts; rows behind the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def session_episodes(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): episodes that end after ``gap`` without an event."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_reviews(reviews: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """One row of each key within the watermark: the first that arrives, whole."""
    return reviews.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def frame_pairs(left: DataFrame, right: DataFrame, time: str, late: str = "1 minute") -> DataFrame:
    """(scene, frame, distance) of two streams of states: an inner join on scene and frame, both with watermarks."""
    a = left.withWatermark(time, late).select("scene", "frame", F.col(time).alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = right.withWatermark(time, late).select("scene", "frame", F.col(time).alias("t2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = F.expr("t2 between t1 - interval 1 minute and t1 + interval 1 minute")
    j = a.join(b, (a.scene == b.scene) & (a.frame == b.frame) & near)
    return j.select(a.scene, a.frame, F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("distance"))


def debounced(states: DataFrame, key: str, order: str, value: str, dwell: int, time: str, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(key, order, confirmed): hysteresis as keyed state; the rows of a batch are taken in order.

    The state is four numbers a key: the confirmed value, the candidate, how long it has stood and the last time. A key without a row for
    ``idle`` behind the watermark is forgotten by an event-time timer, so the state holds the keys of that span only; what comes after begins
    anew, like a first row. Rows behind the watermark are dropped.
    """
    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, candidate, n, last = state.get if state.exists else (None, None, 0, 0)
        started = state.exists
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            v = None if v is None or v != v else int(v)
            n = n + 1 if v == candidate and n else 1
            candidate = v
            if not started or v == current or n >= dwell:
                current, n, started = v, 0, True
            out.append(current)
        last = max(last, int(rows["_ms"].max()))
        state.update((current, candidate, n, last))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "confirmed": pd.array(out, dtype="Int64")})

    timed = states.withWatermark(time, late).withColumn("_ms", F.unix_millis(time))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, confirmed long", "cur long, cand long, n int, last long", "append", GroupStateTimeout.EventTimeTimeout)
