from __future__ import annotations

import random
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from tests.conftest import final_plan
from tripline.operators.baseline import KnownTuples
from tripline.operators.lookups import novel_vs_baseline

SCHEMA = "a string, b string, c string"


@pytest.fixture
def known(spark, tmp_path):
    name = f"known_{uuid4().hex}"
    yield KnownTuples(spark, name, str(tmp_path / "known"), ["a", "b"], "c", 4)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def made(state, count, nulls):
    pool = ["1", "2", "3", "4", *([None] if nulls else [])]
    return [tuple(state.choice(pool) for _ in range(3)) for _ in range(count)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("learned_nulls, probe_nulls", [(False, False), (True, False), (False, True), (True, True)])
def test_a_kept_baseline_equals_one_learned_at_once(spark, known, learned_nulls, probe_nulls):
    state = random.Random(f"{learned_nulls}{probe_nulls}")
    learned = spark.createDataFrame(made(state, 12, learned_nulls), SCHEMA)
    probes = spark.createDataFrame(made(state, 90, probe_nulls), SCHEMA)
    known.learn(learned.limit(5))
    known.learn(learned)
    wanted = rows(novel_vs_baseline(probes, learned, ["a", "b"], "c"))
    assert rows(known.novel(probes)) == wanted
    known.compact()
    known.learn(learned)
    assert rows(known.novel(probes)) == wanted
    assert known.rows().count() == learned.where("c is not null").distinct().count()


def test_stored_tuples_give_the_same(spark, work):
    state = random.Random(9)
    learned, probes = (spark.createDataFrame(made(state, n, True), SCHEMA) for n in (8, 60))
    assert rows(novel_vs_baseline(probes, learned, ["a", "b"], "c", work)) == rows(novel_vs_baseline(probes, learned, ["a", "b"], "c"))


def test_appends_leave_files_and_a_compaction_brings_one_per_bucket(spark, known):
    numbers = spark.range(400).select(*[(F.col("id") % n).cast("string").alias(c) for n, c in ((7, "a"), (11, "b"), (400, "c"))])
    for end in (100, 250, 400):
        known.learn(numbers.where(F.col("c").cast("int") < end))
    assert len(known.rows().inputFiles()) == 12
    known.compact()
    assert len(known.rows().inputFiles()) == 4 and known.rows().count() == 400
    known.learn(numbers)
    assert known.rows().count() == 400


def test_the_baseline_is_not_shuffled(spark, known):
    numbers = spark.range(2000).select(*[(F.col("id") % n).cast("string").alias(c) for n, c in ((7, "a"), (11, "b"), (2000, "c"))])
    known.learn(numbers)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        complete = known._renamed(known.rows().dropna(subset=["a", "b"]))
        joined = numbers.join(complete, [F.col(n) == F.col(f"_b_{n}") for n in "abc"], "left_anti")
        plan = final_plan(joined).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange, for the new rows; the bucketed scan has none above it.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert plan.index("Exchange hashpartitioning") < plan.index("FileScan")
