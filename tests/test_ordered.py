from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tests.conftest import final_plan
from tripline.operators.ordered import first_in_order

START = datetime(2024, 5, 1)


def brute_first(rows):
    """Ids of the earliest row of each key: NULL times first, ties to the smallest id."""
    best = {}
    for number, key, when in rows:
        rank = (when is not None, when or START, number)
        if key not in best or rank < best[key]:
            best[key] = rank
    return sorted(rank[2] for rank in best.values())


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_the_first_row_of_each_key_is_marked(spark, work, partitions):
    """A key with half of all rows lies in several partitions."""
    state = random.Random(partitions)
    rows = [
        (n, state.choice(["hot"] * 8 + ["a", "b", None, f"k{n // 9}"]), state.choice([None, START, START + timedelta(seconds=n % 50)]))
        for n in range(600)
    ]
    frame = spark.createDataFrame(rows, "_part long, k string, _new timestamp_ntz").withColumnsRenamed({"_part": "id", "_new": "t"})
    found = first_in_order(frame.repartition(4), ["k"], "t", ["id"], "first", work, partitions)
    assert found.columns == ["id", "k", "t", "first"] and found.count() == 600
    assert sorted(r["id"] for r in found.where("first").collect()) == brute_first(rows)
    if partitions > 3:
        assert found.where("k = 'hot'").select(found["k"]).inputFiles() and len(found.inputFiles()) > 3


def test_a_key_of_several_columns_that_may_be_null(spark, work):
    rows = [(n, *key) for n, key in enumerate([("a", None), (None, "a"), ("a", None), (None, None), ("a", "a"), (None, None)])]
    frame = spark.createDataFrame(rows, "id long, x string, y string")
    found = first_in_order(frame, ["x", "y"], "id", ["x"], "first", work, 2)
    assert sorted(r["id"] for r in found.where("first").collect()) == [0, 1, 3, 4]


def test_identical_rows_and_no_rows(spark, work):
    same = spark.createDataFrame([("k", START)] * 40, "k string, t timestamp_ntz").repartition(4)
    assert first_in_order(same, ["k"], "t", ["k"], "first", work, 4).where("first").count() == 1
    assert first_in_order(same.where("k = 'x'"), ["k"], "t", ["k"], "first", work, 4).count() == 0


def test_one_scan_and_one_shuffle(spark, work, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k", "id % 11 as t").write.parquet(str(tmp_path / "log"))
    stored = []

    class Seen:
        def store(self, df, name):
            stored.append(df)
            return work.store(df, name)

    first_in_order(spark.read.parquet(str(tmp_path / "log")), ["k"], "t", ["id"], "first", Seen(), 4)
    plan = final_plan(stored[0]).split("== Initial Plan ==")[0]
    assert len(stored) == 1 and plan.count("FileScan") == 1 and plan.count("Exchange rangepartitioning") == 1
    assert "Window" not in plan and "Join" not in plan
