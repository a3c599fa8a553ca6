"""Testing where the rows are read whether a key can be among some rare ones.

A Bloom filter is aggregated from the rare keys and tested in the scan stage of
the large table, before anything is shuffled. It lets every row with a rare
key pass and others only by chance, so what depends on the rows that pass does not
change.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size up to which a filter is sent to every task. A filter of this size holds 14 million keys at one percent.
MAX_BYTES = 16 << 20


def filter_shape(keys: int, false_positives: float) -> tuple[int, int]:
    """Words of 64 bits, and bits set per key, for a share of other keys that may pass."""
    if not 0 < false_positives < 1:
        raise ValueError("the share must lie between 0 and 1")
    bits = -max(keys, 1) * math.log(false_positives) / math.log(2) ** 2
    words = math.ceil(bits / 64)
    return words, max(1, round(64 * words / max(keys, 1) * math.log(2)))


def _places(columns: list[Column], words: int, bits: int) -> list[Column]:
    """The key's bits, by double hashing."""
    size = F.lit(64 * words)
    first, step = (F.pmod(F.xxhash64(F.lit(half), *columns), size) for half in (1, 2))
    return [F.pmod(first + n * step, size) for n in range(bits)]


def can_be_among(
    big: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], false_positives: float, max_bytes: int = MAX_BYTES
) -> Column | None:
    """A condition on ``big``: true if ``columns`` equal some row of ``keys``, and for others in a share of cases.

    Rows with a NULL in their key, which equal nothing, never pass. ``keys`` is
    read twice, to count its distinct rows and to build the filter, so it should be a stored
    table. The filter is one value in the plan, built by Spark before the scan
    starts. None if a filter of that share would be larger than ``max_bytes``: the caller then does without.
    """
    # A key that does not fit the large table's type equals nothing there.
    typed = [F.col(old).try_cast(big.schema[new].dataType).alias(f"k{n}") for n, (old, new) in enumerate(zip(key_columns, columns))]
    distinct = keys.select(*typed).dropna().distinct()
    words, bits = filter_shape(distinct.count(), false_positives)
    if 8 * words > max_bytes:
        return None
    place = F.explode(F.array(*_places([F.col(name) for name in distinct.columns], words, bits)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    filled = distinct.select(place.alias("place")).select(F.floor(F.col("place") / 64).alias("word"), one.alias("bits"))
    empty = distinct.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    by_word = filled.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    filter_words = by_word.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all")).select("all.bits").scalar()
    found = F.lit(True)
    for name in columns:
        found = found & F.col(name).isNotNull()
    for place in _places([F.col(name) for name in columns], words, bits):
        word = F.get(filter_words, F.floor(place / 64).cast("int"))
        found = found & (F.bit_get(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return found
