"""First and latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.operators.sizing import apart


def latest_per_key(df: DataFrame, keys: list[str], time_col: str, tie_break: list[str]) -> DataFrame:
    """The row with the highest time of each key; ties go to the highest ``tie_break``.

    ``row_number() == 1`` lets Spark keep one row per key and map task before
    the shuffle (WindowGroupLimit), so a hot key does not travel.
    """
    order = [F.col(name).desc() for name in [time_col, *tie_break]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def first_seen_flag(df: DataFrame, keys: list[str], time_col: str, tie_break: list[str], flag: str) -> DataFrame:
    """Add a boolean that is true on exactly one row per key: its earliest one.

    One window per key would sort a hot key in a single task. Here the earliest
    time comes from a partially aggregated minimum, and rows are ranked only
    against rows of the same key *and* time, which settles ties. The input is
    read twice; store it when computing it is dear.
    """
    firsts = (
        df.groupBy(*[F.col(name).alias(f"_k_{name}") for name in keys], apart(keys).alias("_apart"))
        .agg(F.min(time_col).alias("_first"))
        .drop("_apart")
    )
    same_moment = Window.partitionBy(*keys, time_col).orderBy(*tie_break)
    ranked = df.withColumn("_rank", F.row_number().over(same_moment))
    same_key = [F.col(name).eqNullSafe(F.col(f"_k_{name}")) for name in keys]
    is_first = F.col(time_col).eqNullSafe(F.col("_first")) & (F.col("_rank") == 1)
    return (
        ranked.join(firsts, same_key, "left")
        .withColumn(flag, is_first)
        .drop("_first", "_rank", *[f"_k_{name}" for name in keys])
    )
