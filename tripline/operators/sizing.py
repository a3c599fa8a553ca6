"""Reducing a huge log to what can join a handful of rows.

A filter that keeps a handful of rows still looks huge to the planner, which
then shuffles the log to join it. The rare rows are therefore stored first:
the size of their files tells the planner the truth, and it picks between a
broadcast and a shuffle by its own threshold. The plan is the same whatever
the size.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.membership import can_be_among
from tripline.operators.workdir import WorkDir


def apart(keys: list[str]) -> Column:
    """An extra grouping column, computed from the keys, for aggregates that are joined on them.

    The aggregate would otherwise arrive at the join already partitioned by the
    join key. Spark then adds no exchange of its own on that side, and without
    one on both sides the adaptive skew join cannot split a hot key.
    """
    return F.pmod(F.xxhash64(*keys), F.lit(16))


def narrow_to_keys(
    big: DataFrame, alternatives: list[dict[str, str]], rare: DataFrame, work: WorkDir, false_positives: float | None = None
) -> DataFrame:
    """Keep the rows of ``big`` that can join ``rare`` in one of several ways, in one pass, and store them.

    ``rare`` is a stored table. Each alternative maps columns of ``big`` to
    columns of ``rare``. The result is only ever joined to ``rare`` on such
    columns, so dropping the other rows changes nothing.

    With ``false_positives``, a share, a Bloom filter of the rare keys is tested in the scan
    stage, so that where ``rare`` is too large to broadcast only its matches and that
    share of the other rows are shuffled.
    """
    if false_positives is not None:
        tests = [can_be_among(big, list(on), rare, list(on.values()), false_positives) for on in alternatives]
        if all(test is not None for test in tests):
            big = big.where(reduce(or_, tests))
    marked, found = big, F.lit(False)
    for number, on in enumerate(alternatives):
        mark = f"_alternative_{number}"
        names = [f"{mark}_{position}" for position in range(len(on))]
        keys = rare.select(*[F.col(old).alias(new) for old, new in zip(on.values(), names)]).dropna()
        keys = work.store(keys.distinct(), "keys").withColumn(mark, F.lit(True))
        marked = marked.join(keys, [F.col(column) == F.col(name) for column, name in zip(on, names)], "left")
        found = found | F.col(mark).isNotNull()
    return work.store(marked.where(found).select(*big.columns), "narrowed")
