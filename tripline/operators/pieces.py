"""Sets of any size, kept in pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.operators.sizing import apart
from tripline.operators.workdir import WorkDir

#: Values that a piece holds at most.
PIECE = 10_000


def set_pieces(df: DataFrame, keys: list[str], column: str, work: WorkDir, values: str = "values", piece: int = PIECE) -> DataFrame:
    """The distinct non-null values of each group as sorted arrays of at most ``piece`` values.

    One row per piece: ``keys``, the number ``piece``, ``values``, and ``size``,
    the number of values of the whole group. A value is in exactly one piece.
    Groups without values have no row; NULL keys are a group.

    The distinct values are stored in ``work``, when this is called, spread over groups and values.
    A group is then dealt by hash into as many parts as it needs, and a part
    that got more than ``piece`` is cut in order. No task and no row ever holds more
    than a part, however large the group is.
    """
    names = [f"k{n}" for n in range(len(keys))]
    distinct = df.where(F.col(column).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(column).alias("value"))
    distinct = work.store(distinct.distinct(), "distinct")
    sizes = distinct.groupBy(*names, apart(names).alias("apart")).agg(F.count("*").alias("size")).drop("apart")
    sizes = work.store(sizes.select(*[F.col(n).alias(f"of_{n}") for n in names], "size"), "sizes")
    same = [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names]
    parts = F.ceil(F.col("size") * 2 / piece)
    dealt = distinct.join(sizes, same).withColumn("part", F.pmod(F.xxhash64("value"), parts))
    in_part = Window.partitionBy(*names, "part").orderBy("value")
    cut = dealt.withColumn("cut", F.floor((F.row_number().over(in_part) - 1) / piece))
    return (
        cut.groupBy(*names, "part", "cut", "size")
        .agg(F.array_sort(F.collect_list("value")).alias(values))
        .select(
            *[F.col(n).alias(k) for k, n in zip(keys, names)],
            F.concat_ws("-", "part", "cut").alias("piece"), values, "size",
        )
    )


def put_together(pieces: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """One row per group with its whole sorted set: only for groups whose sets fit in a row."""
    return pieces.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(values))).alias(values), F.max("size").alias("size"))
