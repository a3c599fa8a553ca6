"""Event time of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.timeops import utc_instant


def timed(stream: DataFrame, time_col: str, lateness: int, name: str) -> DataFrame:
    """Add the event time as the instant ``name``, with a watermark ``lateness`` seconds behind the latest one.

    Rows without a time can neither be late nor in time; they are left out.
    """
    at = stream.where(F.col(time_col).isNotNull()).withColumn(name, utc_instant(time_col))
    return at.withWatermark(name, f"{int(lateness)} seconds")
