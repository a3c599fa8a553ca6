"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of times it is taken. The rates
stay as close as possible, in relative entropy per word, to given base rates,
while the words taken from each source meet its target. The solution tilts the
base rates exponentially by one multiplier per source, cut at the largest
allowed rate; Newton steps on the convex dual find the multipliers. Each step
is one aggregation; sources are rows of a table, never a list on the driver.

The base rate of a document is one over the number of its source's rows with the
same text, so copies of a text weigh as much as one, however many there are;
a multiplier then has no closed form where a source has copies.

Rates become whole copies by carrying the rounding error, counted in words,
from document to document within small groups of a source, the largest first,
so that a group misses its target by about half of its smallest document. The
groups are hashes of ids, so reruns agree and no source is handled in one piece.

NULL is a source of its own, the last. NULL and empty texts have size 0. A
source without words has target 0 and rate 0. Rows that repeat are rounded one
by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.common import INNER, word_count
from tripline.operators.sizing import apart
from tripline.operators.workdir import WorkDir

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
GROUP_ROWS = 128
TOLERANCE = 1e-9
MAX_STEPS = 60

SOURCE, SIZE, SOURCE_SIZE = f"{INNER}source", f"{INNER}size", f"{INNER}source_size"
TARGET, RATE, GROUP, COPIES = f"{INNER}target", f"{INNER}rate", f"{INNER}group", f"{INNER}copies"
DOCS, TILT, TIE, BASE = f"{INNER}docs", f"{INNER}tilt", f"{INNER}tie", f"{INNER}base"


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_copies: float = MAX_COPIES,
) -> DataFrame:
    """Target of each source: ``source``, ``source_size``, ``n_docs``, ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, NULL
    last, take the weights in turn. A target above ``max_copies`` times its
    source is cut to that, and what is left over is shared among the others by
    weight, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row per source, never per document.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    totals = totals.withColumn("weight", weight)
    cap = max_copies * F.col("source_size")
    wanted = total_share * (totals.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level = 0.0
    while True:
        capped = (F.lit(level) * F.col("weight")) > cap
        row = totals.agg(
            F.sum(F.when(capped, cap)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("free")
        ).first()
        if not row["free"]:
            break
        following = (wanted - (row["taken"] or 0.0)) / row["free"]
        if following <= level * (1 + 1e-12):
            break
        level = following
    return totals.select(
        "source", "source_size", "n_docs", F.least(F.lit(level) * F.col("weight"), cap).alias("target")
    )


def balance(cells: DataFrame, targets: DataFrame, work: WorkDir, max_copies: float = MAX_COPIES) -> DataFrame:
    """Multiplier of each source: ``targets`` with ``tilt``; a rate is ``base * exp(tilt)``, at most ``max_copies``.

    ``cells`` has ``source``, ``base`` (a base rate above 0) and ``size`` (words
    of the documents that share both). ``tilt`` is NULL where the target is 0.
    """
    current = work.store(
        targets.withColumn("tilt", F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size")))),
        "tilt",
    )
    cells = cells.select(F.col("source").alias("cell_source"), "base", F.col("size").alias("cell_size"))
    for _ in range(MAX_STEPS):
        free = F.col("base") * F.exp("tilt")
        joined = current.join(cells, _same("source", "cell_source"), "left")
        dual = joined.groupBy(*current.columns).agg(
            F.sum(F.col("cell_size") * F.least(free, F.lit(max_copies))).alias("gradient"),
            F.sum(F.when(free < max_copies, F.col("cell_size") * free).otherwise(0.0)).alias("hessian"),
        )
        miss = F.col("gradient") - F.col("target")
        off = F.abs(miss) > TOLERANCE * F.col("target")
        step = F.least(F.greatest(-miss / F.col("hessian"), F.lit(-1.0)), F.lit(1.0))
        moved = F.when(off & (F.col("hessian") > 0), F.col("tilt") + step).otherwise(F.col("tilt"))
        following = work.store(
            dual.select(*targets.columns, moved.alias("tilt"), (off & (F.col("hessian") > 0)).alias("off")), "tilt"
        )
        done = not following.where("off").limit(1).count()
        work.drop(current)
        current = following.drop("off")
        if done:
            break
    return current


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies for rows sorted by source, group and falling size; the error in words is carried inside a group."""
    key, error = None, 0.0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in (SOURCE, GROUP, SIZE, RATE)]
        copies = np.zeros(batch.num_rows, dtype=np.int64)
        for row, (source, group, size, rate) in enumerate(zip(*columns)):
            if (source, group) != key:
                key, error = (source, group), 0.0
            low = int(rate + 1e-9)
            wanted = rate * size + error
            taken = low if rate - low <= 1e-9 or wanted - low * size < size / 2 else low + 1
            error = wanted - taken * size
            copies[row] = taken
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies)], names=[*batch.schema.names, COPIES])


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with what mixing needs of the text: its size and a hash that orders rows that are alike otherwise."""
    return docs.withColumn(SIZE, word_count("text")).withColumn(TIE, F.xxhash64("text"))


def with_base(sized: DataFrame, work: WorkDir) -> DataFrame:
    """``sized`` with the base rate of each row, one over the number of its source's rows with the same text.

    Only texts that repeat are counted in a table of their own, so the rows
    are moved only where that table is too large to broadcast.
    """
    rows = sized.select(F.col("source").alias("of_source"), F.col(TIE).alias("of_text"))
    copies = rows.groupBy("of_source", "of_text", apart(["of_source", "of_text"]).alias("part")).agg(F.count("*").alias("rows"))
    copies = work.store(copies.where(F.col("rows") > 1).drop("part"), "copies")
    joined = sized.join(copies, _same("source", "of_source") & (F.col(TIE) == F.col("of_text")), "left")
    return joined.withColumn(BASE, 1 / F.coalesce("rows", F.lit(1))).drop("of_source", "of_text", "rows")


def mix(sized: DataFrame, work: WorkDir, base: str | None = None, max_copies: float = MAX_COPIES) -> DataFrame:
    """``sized`` with source size, target, rate and copies in columns named by this module's constants.

    ``sized`` comes from the function of that name; besides its columns only
    ``doc_id`` and ``source`` are needed, and all columns there are get carried
    along. ``base`` names a column of base rates above 0; without it they are those of
    ``with_base``.
    """
    if not base:
        sized, base = with_base(sized, work), BASE
    sizes = work.store(sized.select("source", F.col(SIZE).alias("size"), F.col(base).cast("double").alias("base")), "sizes")
    targets = work.store(source_targets(sizes, max_copies=max_copies), "targets")
    cells = work.store(sizes.groupBy("source", "base").agg(F.sum("size").alias("size")), "cells")
    tilts = balance(cells, targets, work, max_copies).select(
        F.col("source").alias(SOURCE),
        F.col("source_size").alias(SOURCE_SIZE),
        F.col("target").alias(TARGET),
        F.col("n_docs").alias(DOCS),
        F.col("tilt").alias(TILT),
    )
    rate = F.least(F.col(base) * F.exp(TILT), F.lit(max_copies))
    groups = F.ceil(F.col(DOCS) / GROUP_ROWS)
    joined = (
        sized.join(tilts, _same("source", SOURCE))
        .withColumn(RATE, F.coalesce(rate, F.lit(0.0)))
        .withColumn(GROUP, F.pmod(F.xxhash64("doc_id", SIZE), groups))
        .drop(DOCS, TILT, BASE)
    )
    dealt = joined.repartition(SOURCE, GROUP).sortWithinPartitions(
        SOURCE, GROUP, F.col(SIZE).desc(), "doc_id", TIE
    )
    schema = T.StructType([*dealt.schema.fields, T.StructField(COPIES, T.LongType())])
    return dealt.mapInArrow(_rounded, schema)


def mixed_documents(docs: DataFrame, work: WorkDir) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; columns as they were."""
    names = docs.columns
    found = mix(sized(docs), work)
    repeats = F.explode(F.array_repeat(F.lit(1), F.col(COPIES).cast("int"))).alias(GROUP)
    return found.select(*names, repeats).select(*names)
