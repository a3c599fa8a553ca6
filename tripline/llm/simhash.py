"""Near-duplicates by SimHash with pivot distance tables.

A fingerprint is compared to 65 reference fingerprints (pivots): zero, and for
each of four 16-bit bands the band's ones and its 15 non-constant Walsh codes.
Two fingerprints at distance ``d`` differ by at most ``d`` in every pivot
distance. The differences between a band's pivot distances and the distance to
zero fix the band, and fingerprints that differ in at most two bits agree in
at least two bands, so every link shares one of six keys made of the pivot
distances of two bands. Pairs that share a key are discarded by their largest
difference over all pivots; what is left is verified by the Hamming distance.

A key that many different fingerprints share is not paired: its fingerprints
become rows for each point at distance 0 or 1 from them. Two fingerprints are
at distance 2 or less exactly if they share such a point, at most 65 different
ones share any, and hanging them on the smallest keeps every component.

Repeated fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.common import lower_ascii_words
from tripline.llm.components import connected_components
from tripline.operators.sizing import apart
from tripline.operators.workdir import WorkDir

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BANDS, BAND_BITS = 4, 16
#: Fingerprints that may share a key and still be compared pair by pair.
PAIRED = 48
_CHUNK = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _walsh(code: int) -> int:
    """Bits j of a band where the parity of ``code & j`` is odd."""
    return sum(((code & bit).bit_count() & 1) << bit for bit in range(BAND_BITS))


def band_pivots(band: int) -> list[int]:
    ones = (1 << BAND_BITS) - 1
    return [pattern << (band * BAND_BITS) for pattern in [ones, *(_walsh(code) for code in range(1, BAND_BITS))]]


PIVOTS = [0, *(pivot for band in range(BANDS) for pivot in band_pivots(band))]


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text; NULL or no words: 0."""
    found = lower_ascii_words(text)
    if not found:
        return 0
    count = max(1, len(found) - SHINGLE + 1)
    totals = np.zeros(64, dtype=np.int64)
    for start in range(0, count, _CHUNK):
        part = found[start : start + min(_CHUNK, count - start) + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(part) >= SHINGLE else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(shingle, SEED) for shingle in shingles], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > count, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_signed(fingerprint(text)) for text in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (signed 64 bits) to the columns of ``docs``; replaces one of that name."""
    return docs.withColumn("fingerprint", _fingerprints(F.col(text)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_distance(fingerprint: Column, pivot: int) -> Column:
    return F.bit_count(fingerprint.bitwiseXOR(F.lit(_signed(pivot))))


def largest_difference(a: Column, b: Column) -> Column:
    """Largest difference of two fingerprints' distances to a pivot."""
    return F.greatest(*(F.abs(pivot_distance(a, pivot) - pivot_distance(b, pivot)) for pivot in PIVOTS))


def _keys(fingerprint: Column) -> Column:
    """Six keys, each made of the pivot distances of two bands relative to the distance to zero."""
    zero = pivot_distance(fingerprint, 0)
    bands = [
        F.concat_ws(",", *((pivot_distance(fingerprint, pivot) - zero).cast("string") for pivot in band_pivots(band)))
        for band in range(BANDS)
    ]
    return F.array(*(F.xxhash64(F.lit(f"{a}{b}"), bands[a], bands[b]) for a, b in combinations(range(BANDS), 2)))


def _points(fingerprint: Column) -> Column:
    """The fingerprint and its 64 neighbours at distance 1."""
    return F.array(fingerprint, *(fingerprint.bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)))


def links(fingerprints: DataFrame, work: WorkDir, paired: int = PAIRED) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints, enough to connect all that are linked.

    ``fingerprints`` has one column of distinct signed fingerprints. Every
    edge joins fingerprints at ``MAX_BITS`` or fewer differing bits.
    """
    keyed = fingerprints.select("fingerprint", F.explode(_keys(F.col("fingerprint"))).alias("key"))
    sizes = keyed.groupBy("key", apart(["key"]).alias("part")).agg(F.count("*").alias("members"))
    sizes = sizes.where(F.col("members") > 1).select(F.col("key").alias("shared"), "members")
    shared = work.store(
        keyed.join(sizes, F.col("key") == F.col("shared")).select("key", "fingerprint", "members"), "keys"
    )
    few = shared.where(F.col("members") <= paired)
    a, b = F.col("a"), F.col("b")
    pairs = (
        few.select("key", F.col("fingerprint").alias("a"))
        .join(few.select(F.col("key").alias("other_key"), F.col("fingerprint").alias("b")),
              (F.col("key") == F.col("other_key")) & (a < b)
              & (largest_difference(a, b) <= MAX_BITS) & (distance(a, b) <= MAX_BITS))
        .select("a", "b")
    )
    many = shared.where(F.col("members") > paired).select("fingerprint").distinct()
    stars = (
        many.select("fingerprint", F.explode(_points(F.col("fingerprint"))).alias("point"))
        .groupBy("point")
        .agg(F.collect_list("fingerprint").alias("near"))
        .where(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .where(a != b)
    )
    return pairs.union(stars).distinct()


def _components(distinct: DataFrame, work: WorkDir) -> DataFrame:
    """``distinct`` (one row per ``fingerprint``) with the ``root`` fingerprint of its component."""
    tree = connected_components(links(distinct.select("fingerprint"), work), work)
    return distinct.join(tree, F.col("fingerprint") == F.col("node"), "left").select(
        *distinct.columns, F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(docs: DataFrame, work: WorkDir, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (signed), ``component_id``.

    ``component_id`` is the smallest id reachable over links. NULL and empty
    texts have fingerprint 0 and are linked like any other; repeated rows are
    in one component; a NULL id is in its component without naming it, so a
    component of NULL ids only has a NULL id. Other columns are not read.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = work.store(with_fingerprint(marked).select("doc_id", "fingerprint"), "fingerprints")
    distinct = work.store(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct"
    )
    rooted = _components(distinct, work)
    first = (
        rooted.groupBy("root", apart(["root"]).alias("part"))
        .agg(F.min("first_id").alias("component_id"))
        .select(F.col("root").alias("of_root"), "component_id")
    )
    members = work.store(
        rooted.join(first, F.col("root") == F.col("of_root")).select(
            F.col("fingerprint").alias("of_fingerprint"), "component_id"
        ),
        "members",
    )
    return marked.join(members, F.col("fingerprint") == F.col("of_fingerprint")).select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_one_per_group(docs: DataFrame, work: WorkDir, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row for each component of linked fingerprints; columns as they were.

    The row with the smallest id stays, rows without an id come last, ties go
    to the smallest digest of id and text. Rows are told apart by that
    digest, so ids may be NULL or repeat with different texts. Of rows that
    are equal in both, one stays. NULL and empty texts are one group.

    The survivor of a group is found among one candidate per fingerprint, and
    equal rows meet only after each map task has kept one of them, so neither
    a hot fingerprint nor a hot row gathers in one task.
    """
    renamed = docs.toDF(*(f"c{position}" for position in range(len(docs.columns))))
    id_column, text_column = (f"c{docs.columns.index(name)}" for name in (doc_id, text))
    parts = [F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("!")) for name in (id_column, text_column)]
    renamed = renamed.withColumn("row_key", F.md5(F.concat_ws(":", *parts)))
    marked = with_fingerprint(renamed, text_column).select(
        "fingerprint", F.struct(F.col(id_column).isNull(), F.col(id_column), F.col("row_key")).alias("row")
    )
    marked = work.store(marked.groupBy("fingerprint").agg(F.min("row").alias("row")), "fingerprints")
    kept = _components(marked, work).groupBy("root").agg(F.min("row").alias("row"))
    kept = work.store(kept.select(F.col("row.row_key").alias("kept_key")), "kept")
    others = [F.col(f"c{n}") for n, field in enumerate(docs.schema) if not isinstance(field.dataType, (T.MapType, T.VariantType))]
    same_row = Window.partitionBy("row_key").orderBy(F.xxhash64(*others))
    single = renamed.withColumn("position", F.row_number().over(same_row)).where(F.col("position") == 1)
    left = single.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi")
    return left.drop("row_key", "position").toDF(*docs.columns)
