"""Bursts per tumbling window, emitted once the watermark has passed the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.timeops import utc_ntz
from tripline.streaming.events import timed


def burst_stream(
    stream: DataFrame,
    time_col: str,
    keys: list[str],
    seconds: int,
    lateness: int,
    totals: dict[str, Column],
    distinct: dict[str, str] | None = None,
    having: Column | None = None,
    *,
    unique: list[str] | None = None,
    bucket_name: str = "bucket",
    start: str = "start_time",
    end: str = "end_time",
) -> DataFrame:
    """Streaming ``burst``: per window and keys the first and last time, totals and a count of distinct values.

    ``totals`` maps names to numbers that are summed over the events;
    ``distinct`` maps one name to the column whose different values it counts.
    A window is emitted once, in append mode, when the watermark passes its
    end. An event that arrives when the watermark has passed its window is
    late: it is not counted, but reported (``Drained.late``).

    A distinct count is spread over its values: a first aggregation has
    the value among its keys and a second one, fed when the first one's windows
    close, counts them. Both are partially aggregated before their shuffle, so a
    hot key sends one row per value and task, and no state holds a set.

    ``unique`` names an event's identity for logs that deliver events more than
    once: repeats are dropped, and every event no newer than the watermark is
    late then, each counted by itself. That costs a shuffle of all events and a
    state row per event for the length of the delay.
    """
    if distinct is not None and len(distinct) != 1:
        raise ValueError("one distinct count per stream")
    events = timed(stream, time_col, lateness, "_at")
    if unique:
        events = events.dropDuplicatesWithinWatermark(unique)
    size = f"{int(seconds)} seconds"
    values = [F.col(column).alias("_value") for column in (distinct or {}).values()]
    windows = events.groupBy(F.window("_at", size).alias("_window"), *keys, *values).agg(
        F.min(time_col).alias(start),
        F.max(time_col).alias(end),
        *[F.sum(number).alias(name) for name, number in totals.items()],
    )
    if distinct:
        windows = windows.groupBy(F.window(F.window_time("_window"), size).alias("_outer"), *keys).agg(
            F.min(start).alias(start),
            F.max(end).alias(end),
            *[F.sum(name).alias(name) for name in totals],
            *[F.count("_value").alias(name) for name in distinct],
        )
    bucket = utc_ntz(F.col("_outer.start" if distinct else "_window.start")).alias(bucket_name)
    found = windows.select(bucket, *keys, start, end, *totals, *(distinct or {}))
    return found if having is None else found.where(having)
