"""Equi join of two streams with a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.timeops import epoch_seconds, span
from tripline.streaming.events import timed


def interval_join_stream(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    left_time: str,
    right_time: str,
    lo: int,
    hi: int,
    lateness: int,
    how: str = "inner",
) -> DataFrame:
    """Streaming ``interval_join``: right time in ``[left time + lo, left time + hi]`` seconds.

    ``on`` maps left to right key columns; column names of the sides must
    differ. A pair is emitted as soon as both its rows are there. With
    ``how="left"``, a left row without a partner is emitted once, when the
    watermark tells that none can come any more. ``lateness`` is the delay both
    sides may have; the slower side's watermark counts, and rows behind it
    are dropped and reported as late. A side's rows are kept only as long as a
    partner can come.

    As in the batch form, time is cut into buckets as wide as the range and the
    bucket is part of the key, so the state of a hot key is spread over time.
    One side is written once per bucket it can meet: the left one for an inner
    join, the right one for a left join.

    Spark filters a side before it looks at its times, by the caller's
    conditions and by keys that are not NULL: only rows that pass move the watermark.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    width = max(hi - lo, 1)
    left, right = timed(left, left_time, lateness, "_left_at"), timed(right, right_time, lateness, "_right_at")
    first = F.floor((epoch_seconds(left_time) + lo) / width)
    bucket = F.floor(epoch_seconds(right_time) / width)
    if how == "inner":
        left = left.withColumn("_bucket", F.explode(F.array(first, first + 1)))
        right = right.withColumn("_right_bucket", bucket)
    else:
        left = left.withColumn("_bucket", first)
        right = right.withColumn("_right_bucket", F.explode(F.array(bucket, bucket - 1)))
    condition = [F.col(a) == F.col(b) for a, b in on.items()]
    condition += [
        F.col("_bucket") == F.col("_right_bucket"),
        F.col("_right_at") >= F.col("_left_at") + span(lo, "SECOND"),
        F.col("_right_at") <= F.col("_left_at") + span(hi, "SECOND"),
    ]
    return left.join(right, condition, how).drop("_bucket", "_right_bucket", "_left_at", "_right_at")
