"""Membership filter, sets in pieces, file time index."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import final_plan
from tripline.operators.membership import can_be_among, filter_shape
from tripline.operators.pieces import put_together, set_pieces
from tripline.operators.sizing import narrow_to_keys
from tripline.sources import load_source
from tripline.sources.file_times import FileTimes

START = datetime(2024, 6, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- membership


@pytest.fixture
def big(spark):
    number = F.col("id")
    return spark.range(0, 40000, 1, 4).select(
        F.concat(F.lit("h"), number % 211).alias("x"), F.when(number % 17 != 0, number).alias("y"), number.alias("n")
    )


@pytest.mark.parametrize("share", [0.2, 0.01])
def test_every_match_and_few_others_pass(spark, big, work, share):
    rare = work.store(big.where("n % 400 = 1").select(F.col("y").cast("string").alias("b"), F.col("x").alias("a")), "rare")
    passing = big.where(can_be_among(big, ["x", "y"], rare, ["a", "b"], share))
    matches = big.where("n % 400 = 1 and y is not null")
    assert set(rows(matches)) <= set(rows(passing))
    others = passing.count() - matches.count()
    assert others <= 1.6 * share * big.count() and passing.where("y is null").count() == 0


def test_the_filter_is_tested_before_the_shuffle(spark, big, work):
    rare = work.store(big.where("n % 400 = 1").select("x", "y"), "rare")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        passing = big.where(can_be_among(big, ["x", "y"], rare, ["x", "y"], 0.01)).repartition("x")
        plan = final_plan(passing).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    shuffle = next(n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    tested = next(n for n, line in enumerate(lines) if "Filter" in line and "bit_get" in line.replace("getbit", "bit_get"))
    assert shuffle < tested  # The plan is printed from the top.


@pytest.mark.parametrize("share", [None, 0.5, 0.001])
def test_narrowing_gives_the_same_with_a_filter(spark, big, work, share):
    rare = work.store(spark.createDataFrame([("h1", 1), ("h2", 213), ("h2", None), (None, 5)], "ra string, rb int"), "rare")
    found = narrow_to_keys(big, [{"x": "ra", "y": "rb"}, {"x": "ra", "n": "rb"}], rare, work, share)
    assert rows(found) == [("h1", 1, 1), ("h2", 213, 213)]


def test_no_keys_and_too_many(spark, big, work):
    none = work.store(big.where("n < 0").select("x"), "none")
    assert big.where(can_be_among(big, ["x"], none, ["x"], 0.01)).count() == 0
    many = work.store(big.select("n"), "many")
    assert can_be_among(big, ["n"], many, ["n"], 0.01, max_bytes=1000) is None
    assert narrow_to_keys(big, [{"n": "n2"}], work.store(many.toDF("n2"), "many"), work, 0.01).count() == 40000


def test_keys_that_do_not_fit_the_type(spark, work):
    rare = work.store(spark.createDataFrame([("7",), ("x",), (str(1 << 40),)], "k string"), "rare")
    numbers = spark.range(100).select(F.col("id").cast("int").alias("n"))
    found = rows(numbers.where(can_be_among(numbers, ["n"], rare, ["k"], 0.0001)))
    assert (7,) in found and len(found) <= 3


def test_shapes():
    words, bits = filter_shape(1_000_000, 0.01)
    assert 9.5e6 < 64 * words < 9.7e6 and bits == 7
    with pytest.raises(ValueError):
        filter_shape(10, 1.0)


# --- sets in pieces


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_pieces_hold_each_value_once(spark, work, piece):
    state = random.Random(piece)
    made = [(state.choice(["hot", "hot", "hot", "a", None]), state.choice(["m", None]), state.choice([None, *range(90)])) for _ in range(700)]
    frame = spark.createDataFrame(made, "k string, l string, value long").repartition(5)
    pieces = set_pieces(frame, ["k", "l"], "value", work, "all", piece)
    wanted = {}
    for k, l, value in made:
        if value is not None:
            wanted.setdefault((k, l), set()).add(value)
    found = {}
    for row in pieces.collect():
        assert 0 < len(row["all"]) <= piece and row["all"] == sorted(row["all"])
        assert row["size"] == len(wanted[row["k"], row["l"]])
        found.setdefault((row["k"], row["l"]), []).extend(row["all"])
    assert {key: sorted(values) for key, values in found.items()} == {key: sorted(values) for key, values in wanted.items()}
    whole = put_together(pieces, ["k", "l"], "all")
    assert {(r["k"], r["l"]): r["all"] for r in whole.collect()} == {key: sorted(values) for key, values in wanted.items()}


def test_a_group_with_nearly_all_values(spark, work):
    """Three million values of one group; a piece holds at most 10,000 of them."""
    frame = spark.range(0, 3_000_000, 1, 8).select(F.when(F.col("id") % 100 != 0, F.lit("hot")).otherwise(F.lit("b")).alias("k"), "id")
    pieces = set_pieces(frame, ["k"], "id", work)
    summary = pieces.groupBy("k").agg(F.max(F.size("values")), F.sum(F.size("values")), F.max("size"))
    assert {r[0]: (r[1] <= 10_000, r[2], r[3]) for r in summary.collect()} == {
        "hot": (True, 2_970_000, 2_970_000), "b": (True, 30_000, 30_000),
    }


def test_no_values(spark, work):
    assert set_pieces(spark.createDataFrame([("a", None)], "k string, v long"), ["k"], "v", work).count() == 0


# --- file times


@pytest.fixture
def log(spark, tmp_path):
    """Five files of ten hours each; the last one also has a row without a time."""
    folder = f"{tmp_path}/a log"
    for number in range(5):
        hours = [(number * 10 + n, START + timedelta(hours=number * 10 + n)) for n in range(10)]
        if number == 4:
            hours.append((99, None))
        spark.createDataFrame(hours, "id long, event_time timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_only_files_of_the_range_are_opened(spark, log, tmp_path):
    times = FileTimes(spark, f"{tmp_path}/times")
    times.update(spark.read.parquet(log).inputFiles())
    assert len(times.files()) == 5
    assert len(times.files(START + timedelta(hours=35))) == 2
    assert len(times.files(None, START + timedelta(hours=9))) == 2  # The first one, and the one with a timeless row.
    schema = "id long, event_time timestamp_ntz"
    found = times.read(schema, START + timedelta(hours=12), START + timedelta(hours=20))
    assert len(found.inputFiles()) == 3
    assert sorted(r["id"] for r in found.collect()) == [*range(12, 21), 99]


def test_new_files_are_added_once(spark, log, tmp_path):
    times = FileTimes(spark, f"{tmp_path}/times")
    files = sorted(spark.read.parquet(log).inputFiles())
    times.update(files[:2])
    times.update(files)
    times.update(files)
    assert len(times.files()) == 5 and spark.read.parquet(f"{tmp_path}/times").count() == 5
    times.rebuild(log)
    assert len(times.files()) == 5


def test_a_source_is_loaded_through_its_file_times(spark, table, tmp_path):
    for day in (1, 2, 3):
        stored = table("gcp_audit", [{"event_time": f"2024-01-0{day} 12:00:00", "resource": {"labels": {"unique_id": str(day)}}}])
        stored.withColumn("resource", F.to_json("resource")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    times = FileTimes(spark, str(tmp_path / "times"))
    times.rebuild(str(tmp_path / "log"))
    found = load_source(spark, "gcp_audit", str(tmp_path / "log"), file_times=times, since="2024-01-02 13:00:00")
    assert [r[0] for r in found.select(F.variant_get("resource", "$.labels.unique_id", "string")).collect()] == ["3"]
    assert load_source(spark, "gcp_audit", str(tmp_path / "log"), file_times=times, since="2025-01-01").count() == 0
