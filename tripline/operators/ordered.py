"""What depends on the row before, over a whole table in order, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.workdir import WorkDir

#: Marks on the first and the last row of a partition.
_FIRST, _LAST = 1, 2


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, to rows in order whose last column is a key, the partition, its edges, and whether the key is another one."""
    part, before, held = TaskContext.get().partitionId(), None, None

    def marked(batch: pa.RecordBatch, edges: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        more = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(edges, pa.int32()), pa.array(new, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_edge", "_new"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.num_columns - 1).to_numpy()
        edges = np.zeros(len(keys), np.int32)
        edges[0] = _FIRST if before is None else 0
        new = np.concatenate(([before is None or keys[0] != before], keys[1:] != keys[:-1]))
        before = keys[-1]
        if held:
            yield marked(*held)
        held = batch, edges, new
    if held:
        held[1][-1] |= _LAST
        yield marked(*held)


def first_in_order(
    df: DataFrame, keys: list[str], time_col: str, tie_break: list[str], flag: str, work: WorkDir, partitions: int | None = None
) -> DataFrame:
    """Add a boolean that is true on exactly one row per key, its earliest one: ``first_seen_flag`` with one read.

    The table is cut into ranges of (key, time), so a hot key spans as many
    partitions as it needs; within a partition the rows stand in order, and a row is
    a key's first one if the row before has another key. Only a partition's
    first row looks across its border: the first and last key of every partition, two
    rows each, tell whether its key began in an earlier one. The ordered rows are stored in
    ``work`` when this is called. Cutting into ranges samples the order columns beforehand.

    Keys are compared by a 64-bit hash of neighbouring rows, which differ by
    chance once in 2^64 borders. NULL is a key, and NULL times come first.
    """
    parts = [*[F.col(name).isNull() for name in keys], *[F.col(name) for name in keys]]
    order = [*keys, time_col, *[name for name in tie_break if name not in keys]]
    rows = df.withColumn("_key", F.xxhash64(*parts))
    laid = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    names = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields)
    marked = laid.sortWithinPartitions(*order).mapInArrow(_mark, f"{names}, _part int, _edge int, _new boolean")
    stored = work.store(marked, "ordered")
    edges = stored.where(F.col("_edge") != 0).select("_part", "_edge", "_key").collect()
    continued, before = [], None
    for edge in sorted(edges, key=lambda edge: (edge["_part"], edge["_edge"])):
        if edge["_edge"] & _FIRST and before is not None and edge["_key"] == before:
            continued.append(edge["_part"])
        before = edge["_key"]
    goes_on = (F.col("_edge").bitwiseAND(_FIRST) != 0) & F.col("_part").isin(continued)
    return stored.withColumn(flag, F.col("_new") & ~goes_on).select(*df.columns, flag)
