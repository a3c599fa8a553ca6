"""Joins against a lookup or a learned baseline.

Lookups are reduced to distinct values first. No broadcast hint is given: Spark
broadcasts a lookup when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides,
where the adaptive skew join splits a hot key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.predicates import full_match
from tripline.operators.sizing import apart
from tripline.operators.workdir import WorkDir


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, laid out so that a join on all their columns can be split."""
    return df.withColumn("_apart", apart(df.columns)).distinct().drop("_apart")


def distinct_values(lookup: DataFrame, column: str, alias: str) -> DataFrame:
    return distinct_rows(lookup.select(F.col(column).alias(alias)).where(F.col(alias).isNotNull()))


def flag_known(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str, flag: str) -> DataFrame:
    """Add a boolean that tells whether the value occurs in the lookup; keeps every row."""
    known = distinct_values(lookup, lookup_column, "_known")
    return (
        df.join(known, df[column] == known["_known"], "left")
        .withColumn(flag, F.col("_known").isNotNull())
        .drop("_known")
    )


def exclude_known(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str) -> DataFrame:
    """Rows whose non-null value is not in the lookup.

    NULLs in the lookup are ignored: a literal ``NOT IN`` would return nothing
    at all as soon as the lookup holds one.
    """
    known = distinct_values(lookup, lookup_column, "_known")
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


def keep_known(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str) -> DataFrame:
    """Rows whose value is in the lookup."""
    known = distinct_values(lookup, lookup_column, "_known")
    return df.join(known, F.col(column) == F.col("_known"), "left_semi")


def novel_vs_baseline(
    df: DataFrame, baseline: DataFrame, exact: list[str], optional: str, work: WorkDir | None = None
) -> DataFrame:
    """Rows whose ``(*exact, optional)`` tuple is surely not in the baseline, as SQL's ``NOT IN`` on a tuple has it.

    A NULL "could be any value": a row is dropped when some baseline row equals
    it in every column where neither of the two is NULL. Baseline rows with a
    NULL ``optional`` are not learned.

    Rows and baseline rows without NULLs, nearly all, meet in one plain anti
    join; what is left goes through ``exclude_possible``. With ``work`` the distinct
    tuples of the baseline are stored, when this is called, instead of being computed for each join.
    """
    columns = [*exact, optional]
    known = baseline.where(F.col(optional).isNotNull()).select(*columns).distinct()
    if work:
        known = work.store(known, "known")
    complete = known.dropna(subset=exact).select(*[F.col(name).alias(f"_b_{name}") for name in columns])
    same = [F.col(name) == F.col(f"_b_{name}") for name in columns]
    return exclude_possible(df.join(distinct_rows(complete), same, "left_anti"), df, known, exact, optional)


def exclude_possible(df: DataFrame, whole: DataFrame, known: DataFrame, exact: list[str], optional: str) -> DataFrame:
    """Drop the rows that some known tuple equals only because one of the two has a NULL.

    ``df`` holds rows of ``whole`` that no known tuple equals outright; ``known`` holds distinct tuples with an ``optional``.

    The rows meet patterns: for each set of columns that known tuples lack, those
    tuples, and each tuple once for every other set of columns that is NULL
    together in some row of ``whole``. Those sets are few, and are looked up first,
    so where no row has NULLs no tuple is repeated.
    """
    columns = [*exact, optional]
    bit = {name: 1 << position for position, name in enumerate(columns)}
    mask = lambda names: sum(bit[name] for name in names)
    lacks = sum((F.when(F.col(name).isNull(), F.lit(bit[name])).otherwise(F.lit(0)) for name in columns), F.lit(0))
    lacking_sets = whole.select(lacks.alias("_lacks")).distinct().agg(F.collect_set("_lacks"))
    for empty in _subsets(exact):
        given = [name for name in columns if name not in empty]
        rows = known
        for name in exact:
            rows = rows.where(F.col(name).isNull() if name in empty else F.col(name).isNotNull())
        # One struct for each set of columns that a compared row may lack; rows without any NULL were compared before.
        variants = [
            F.struct(
                F.lit(mask(lacking)).alias("_mask"),
                *[
                    (F.lit(None).cast(known.schema[name].dataType) if name in lacking else F.col(name)).alias(f"_b_{name}")
                    for name in given
                ],
            )
            for lacking in _subsets(given)
            if empty or lacking
        ]
        compared = F.transform("_sets", lambda lacking: lacking.bitwiseAND(F.lit(mask(given))))
        needed = F.filter(F.array(*variants), lambda one: F.array_contains(compared, one["_mask"]))
        rows = rows.withColumn("_sets", lacking_sets.scalar()).select(F.explode(needed).alias("_v"))
        patterns = distinct_rows(rows.select(*[F.col(f"_v._b_{name}") for name in given]))
        df = df.join(patterns, [F.col(name).eqNullSafe(F.col(f"_b_{name}")) for name in given], "left_anti")
    return df


def _subsets(names: list[str]) -> list[set[str]]:
    return [set(chosen) for size in range(len(names) + 1) for chosen in combinations(names, size)]


def suffix_pattern_join(
    df: DataFrame, column: str, lookup: DataFrame, lookup_column: str, suffix_regex: str, suffix_length: int
) -> DataFrame:
    """Rows of ``df`` whose value is ``<lookup value><suffix>``.

    Splicing every lookup value into a regex would compare all pairs. The suffix
    has a fixed length, so it is checked once per row and cut off, and the rest
    joins by equality.
    """
    head = F.substring(F.col(column), F.lit(1), F.length(column) - suffix_length)
    candidates = df.where(full_match(column, rf"(?s:.+){suffix_regex}")).withColumn("_head", head)
    return keep_known(candidates, "_head", lookup, lookup_column).drop("_head")
