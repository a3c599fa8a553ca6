"""Connected components of a graph given as edges, by alternating star contraction.

Each round first hangs the larger neighbours of every node on the node's
smallest neighbour, then the smaller ones on the smallest of them, until the
edges are stars around the smallest node of each component. Nothing but edges
is moved; a hub's edges are joined in a way the adaptive skew join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.sizing import apart
from tripline.operators.workdir import WorkDir


def _smallest(edges: DataFrame) -> DataFrame:
    found = edges.groupBy("u", apart(["u"]).alias("part")).agg(F.min("v").alias("low"))
    return found.select(F.col("u").alias("node"), "low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("node", F.least("low", "node").alias("low"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(low, F.col("u") == F.col("node"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), F.col("u") == F.col("node"))
    moved = joined.where(F.col("v") > F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(joined.select("u", F.col("low").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, work: WorkDir) -> DataFrame:
    """``edges`` has two columns of one orderable type; returns ``node`` and ``root`` for every node but roots.

    ``root`` is the smallest node of the component. Loops and repeated edges
    are allowed; rows with a NULL end are ignored.
    """
    a, b = edges.columns
    current = work.store(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    signature = _signature(current)
    while signature[0]:
        wide = work.store(_large_star(current), "wide")
        following = work.store(_small_star(wide), "edges")
        work.drop(wide)
        before, signature = signature, _signature(following)
        work.drop(current)
        current = following
        if signature == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
