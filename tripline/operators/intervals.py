"""Equi join with a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.timeops import epoch_seconds, span


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    left_time: str,
    right_time: str,
    lo: int,
    hi: int,
    how: str = "inner",
) -> DataFrame:
    """Join where the right time lies in ``[left time + lo, left time + hi]`` seconds.

    ``on`` maps left to right key columns; column names of the sides must differ.

    Time is cut into buckets as wide as the range and the bucket becomes part of
    the join key, so a hot key is spread over time and only rows at most two
    buckets apart are ever compared. The range then covers two buckets: one side
    is written once per bucket. For an inner join that is the left side, which
    should be the rarer one. A left join must not repeat its left rows, so the
    right side is.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    width = max(hi - lo, 1)
    first = F.floor((epoch_seconds(left_time) + lo) / width)
    bucket = F.floor(epoch_seconds(right_time) / width)
    if how == "inner":
        left = left.withColumn("_bucket", F.explode(F.array(first, first + 1)))
        right = right.withColumn("_right_bucket", bucket)
    else:
        left = left.withColumn("_bucket", first)
        right = right.withColumn("_right_bucket", F.explode(F.array(bucket, bucket - 1)))
    condition = [F.col(a) == F.col(b) for a, b in on.items()]
    condition.append(F.col("_bucket") == F.col("_right_bucket"))
    condition.append(
        F.col(right_time).between(F.col(left_time) + span(lo, "SECOND"), F.col(left_time) + span(hi, "SECOND"))
    )
    return left.join(right, condition, how).drop("_bucket", "_right_bucket")
