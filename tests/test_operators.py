"""Operators against brute force on small random tables, hot keys and NULLs included."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import final_plan
from tripline.operators import overlap
from tripline.operators.aggs import any_of, burst, many_distinct, one_distinct, outcome_counts, sliced_actions, sorted_set
from tripline.operators.intervals import interval_join
from tripline.operators.latest import first_seen_flag, latest_per_key
from tripline.operators.lookups import exclude_known, flag_known, keep_known, novel_vs_baseline, suffix_pattern_join
from tripline.operators.sizing import narrow_to_keys
from tripline.operators.workdir import WorkDir
from tripline.functions.timeops import span, time_slice

START = datetime(2024, 1, 1)
NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def test_known_and_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, ip string")
    lookup = spark.createDataFrame([("a",), ("a",), (None,)], "ip string")
    assert rows(flag_known(df, "ip", lookup, "ip", "known")) == [
        (1, "a", True), (2, "b", False), (3, None, False), (4, "a", True),
    ]
    assert rows(exclude_known(df, "ip", lookup, "ip")) == [(2, "b")]
    assert rows(keep_known(df, "ip", lookup, "ip")) == [(1, "a"), (4, "a")]
    empty = lookup.where("false")
    assert len(rows(exclude_known(df, "ip", empty, "ip"))) == 3


def test_novelty_with_nulls(spark):
    baseline = spark.createDataFrame(
        [("u", "m", "ip1"), ("u", "m", "ip1"), ("v", "m", "ip2"), (None, "m", "ip3"), ("w", "m", None)],
        "actor string, method string, ip string",
    )
    df = spark.createDataFrame(
        [
            (1, "u", "m", "ip1"),  # seen
            (2, "u", "m", "ip2"),  # new address
            (3, "u", "m", None),  # could be any address of a known pair
            (4, "u", "x", None),  # new method
            (5, None, "m", "ip3"),  # no actor: could be any of a known address and method
            (8, "x", "m", "ip3"),  # could be the learned row without an actor
            (9, "x", "n", "ip3"),  # but not with another method
            (10, None, None, "ip9"),  # new address
            (6, "w", "m", None),  # learned only without an address, but could be the row without an actor
            (7, "v", "m", "ip2"),  # seen
        ],
        "id int, actor string, method string, ip string",
    )
    novel = novel_vs_baseline(df, baseline, ["actor", "method"], "ip")
    assert sorted(row["id"] for row in novel.collect()) == [2, 4, 9, 10]
    assert not any(mark in final_plan(novel) for mark in NO_PAIRS)


def test_suffix_join_equals_the_regex_join(spark):
    rng = random.Random(3)
    projects = ["p", "p-1", "proj", "proj-abcdefghijkl", "x.y"]
    names = []
    for _ in range(300):
        length = rng.choice([11, 12, 12, 12, 13])
        tail = "".join(rng.choice("abz09" if rng.random() < 0.95 else "AZ") for _ in range(length))
        names.append(f"{rng.choice(projects + ['none'])}-{tail}{rng.choice(['.json', '.json', 'xjson', '.json0'])}")
    files = spark.createDataFrame([(n,) for n in names], "name string")
    lookup = spark.createDataFrame([(p,) for p in projects] + [(None,)], "project string")
    joined = suffix_pattern_join(files, "name", lookup, "project", r"-[a-z0-9]{12}\.json", 18)

    expected = sorted(
        n for n in names for p in projects if re.fullmatch(re.escape(p) + r"-[a-z0-9]{12}\.json", n)
    )
    assert expected and sorted(row["name"] for row in joined.collect()) == expected
    assert not any(mark in final_plan(joined) for mark in NO_PAIRS)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("lo", "hi"), [(0, 600), (-600, 0), (-30, 90)])
def test_interval_join_equals_all_pairs(spark, how, lo, hi):
    rng = random.Random(7)

    def side(count, hot):
        # A third of the rows share one key.
        made = []
        for number in range(count):
            key = 0 if rng.random() < 0.34 else rng.choice([1, 2, 3, hot, None])
            # Microseconds too: the range is closed to the microsecond.
            when = START + timedelta(seconds=rng.randrange(-3000, 3000), microseconds=rng.choice([0, 0, 1]))
            made.append((number, key, when if rng.random() < 0.97 else None))
        return made

    left, right = side(120, 8), side(150, 9)
    a = spark.createDataFrame(left, "a int, ak int, at timestamp_ntz")
    b = spark.createDataFrame(right, "b int, bk int, bt timestamp_ntz")
    expected = []
    for number, key, when in left:
        found = [
            other
            for other, other_key, other_when in right
            if key is not None and key == other_key and None not in (when, other_when)
            and when + timedelta(seconds=lo) <= other_when <= when + timedelta(seconds=hi)
        ]
        expected += [(number, other) for other in found] or ([(number, None)] if how == "left" else [])
    result = interval_join(a, b, {"ak": "bk"}, "at", "bt", lo, hi, how).select("a", "b")
    assert rows(result) == sorted(expected, key=repr)
    assert not any(mark in final_plan(result) for mark in NO_PAIRS)


def test_interval_join_refuses_other_types(spark):
    with pytest.raises(ValueError):
        interval_join(spark.range(1), spark.range(1), {}, "a", "b", 0, 1, "full")


def test_latest_and_first_per_key(spark):
    rng = random.Random(11)
    made = [
        (n, rng.choice(["hot", "hot", "k1", "k2", None]), START + timedelta(seconds=rng.randrange(20)))
        for n in range(200)
    ]
    df = spark.createDataFrame(made, "id int, k string, t timestamp_ntz")
    by_key = defaultdict(list)
    for number, key, when in made:
        by_key[key].append((when, number))
    latest = latest_per_key(df, ["k"], "t", ["id"])
    assert sorted(row["id"] for row in latest.collect()) == sorted(max(v)[1] for v in by_key.values())
    assert "WindowGroupLimit" in final_plan(latest)
    flagged = first_seen_flag(df, ["k"], "t", ["id"], "first")
    assert flagged.count() == 200
    assert sorted(r["id"] for r in flagged.where("first").collect()) == sorted(min(v)[1] for v in by_key.values())


def test_first_seen_marks_one_of_identical_rows(spark):
    df = spark.createDataFrame([("k", START)] * 3, "k string, t timestamp_ntz")
    assert sorted(r["first"] for r in first_seen_flag(df, ["k"], "t", ["k"], "first").collect()) == [False, False, True]


def test_burst_and_outcomes(spark):
    made = [(START + timedelta(minutes=m), "u", f"o{m % 3}", m % 4 == 0) for m in range(90)]
    df = spark.createDataFrame(made, "t timestamp_ntz, u string, o string, bad boolean")
    result = burst(
        df,
        "t",
        time_slice("t", 3600),
        ["u"],
        [*outcome_counts(F.col("bad")), F.count_distinct("o").alias("objects")],
        F.col("successful_attempts") > 25,
    )
    assert rows(result) == [(START, "u", START, START + timedelta(minutes=59), 45, 15, 3)]


def test_slice_predicates(spark):
    made = [
        ("f1", "read", "7", 0), ("f1", "write", "7", 4),  # one size
        ("f2", "read", "7", 0), ("f2", "write", "8", 4),  # two sizes
        ("f3", "read", None, 0), ("f3", "write", None, 4),  # no size
        ("f4", "read", None, 4), ("f4", "write", None, 5),  # two slices
    ]
    df = spark.createDataFrame(
        [(f, a, s, START + timedelta(seconds=t), "ip") for f, a, s, t in made],
        "f string, a string, s string, t timestamp_ntz, ip string",
    )
    slices = sliced_actions(
        df, "t", ["f"], "a", "ip", 5, (one_distinct("s").alias("one"), many_distinct("s").alias("many"))
    )
    found = {(r["f"], r["one"], r["many"], tuple(r["actions"])) for r in slices.collect()}
    both = ("read", "write")
    assert found == {
        ("f1", True, False, both), ("f2", False, True, both), ("f3", False, False, both),
        ("f4", False, False, ("read",)), ("f4", False, False, ("write",)),
    }
    assert slices.where(any_of("actions", ("write", "gone"))).count() == 4


def test_sorted_set_drops_nulls(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert df.agg(sorted_set("x")).first()[0] == ["a", "b"]


def _random_sets(rng, side, owners=2, sets=40):
    made = []
    for number in range(sets):
        owner = f"u{0 if rng.random() < 0.6 else rng.randrange(owners)}"
        start = START + timedelta(minutes=5 * rng.randrange(0, 6000))
        family = rng.randrange(4)
        size = rng.choice([1, 2, 3, 4, 8, 12, 20])
        # "hot" is in every set: it must not pair everything with everything.
        elements = {"hot"} | {f"f{family}-{rng.randrange(22)}" for _ in range(size)}
        made.append((f"{side}{number}", owner, start, elements))
    return made


@pytest.mark.parametrize("ratio", [0.75, 0.5, 1.0, 0.3])
@pytest.mark.parametrize(("slice_size", "meetings"), [(50_000, 5), (3, 2), (3, 1)])
def test_overlap_join_equals_all_pairs(spark, work, monkeypatch, ratio, slice_size, meetings):
    monkeypatch.setattr(overlap, "PREFIX_SLICE", slice_size)
    monkeypatch.setattr(overlap, "MEETINGS", meetings)
    rng = random.Random(int(ratio * 100))
    earlier, later = _random_sets(rng, "e"), _random_sets(rng, "l")
    # Edges: exactly seven days apart, the same start, one second too far.
    edge = {"e1", "e2", "e3", "e4"}
    later.append(("edge", "u9", START + timedelta(days=7), edge))
    for name, shift in (("in", 0), ("out", -1), ("same", 7 * 86400), ("after", 7 * 86400 + 1)):
        earlier.append((name, "u9", START + timedelta(seconds=shift), edge))
    made = [
        (set_id, is_earlier, owner, start, len(elements), element)
        for side, is_earlier in ((earlier, True), (later, False))
        for set_id, owner, start, elements in side
        for element in elements
    ]
    df = spark.createDataFrame(
        made, "set_id string, is_earlier boolean, owner string, start timestamp_ntz, size long, element string"
    )
    expected = []
    for e_id, e_owner, e_start, e_elements in earlier:
        for l_id, l_owner, l_start, l_elements in later:
            shared = len(e_elements & l_elements)
            if (
                e_owner == l_owner
                and l_start - timedelta(days=7) <= e_start <= l_start
                and shared >= ratio * min(len(e_elements), len(l_elements))
                and shared > 0
            ):
                expected.append((e_id, l_id, shared))
    result = overlap.overlap_join(work.store(df), 7, ratio)
    assert rows(result) == sorted(expected, key=repr)
    assert {("in", "edge", 4), ("same", "edge", 4)} <= set(expected)
    assert not any(mark in final_plan(result) for mark in NO_PAIRS)


def test_a_hot_element_makes_few_candidates(spark):
    """Every set shares one element and nothing else: the prefix must not pair them all."""
    made = [
        (f"{'e' if is_earlier else 'l'}{n}", is_earlier, "u", START, 8, "hot" if k == 0 else f"{is_earlier}{n}-{k}")
        for is_earlier in (True, False)
        for n in range(60)
        for k in range(8)
    ]
    df = spark.createDataFrame(
        made, "set_id string, is_earlier boolean, owner string, start timestamp_ntz, size long, element string"
    )
    prefix = overlap.rare_prefix(df, 0.75)
    assert prefix.count() == 0  # the seven rarest of eight never include the hot one
    assert overlap.overlap_join(df, 7, 0.75).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_novelty_is_the_tuple_rule(spark, seed):
    """Against three-valued logic by hand, with NULLs on both sides."""
    rng = random.Random(seed)

    def made(count):
        return [tuple(rng.choice([None, "1", "2", "3", "4"]) for _ in range(3)) for _ in range(count)]

    learned, probes = made(4 + seed), made(80)
    schema = "a string, b string, c string"

    def unknown_or_equal(x, y):
        return all(p is None or q is None or p == q for p, q in zip(x, y))

    wanted = [p for p in probes if not any(unknown_or_equal(p, q) for q in learned if q[2] is not None)]
    novel = novel_vs_baseline(spark.createDataFrame(probes, schema), spark.createDataFrame(learned, schema), ["a", "b"], "c")
    assert rows(novel) == sorted(wanted, key=repr)
    assert not any(mark in final_plan(novel) for mark in NO_PAIRS)


def test_narrowing_keeps_what_can_join(spark, work):
    rare = work.store(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "ra string, rb string"))
    big = spark.range(1000).select(
        F.when(F.col("id") < 900, F.lit("a")).alias("x"),
        (F.col("id") % 5).cast("string").alias("y"),
        (F.col("id") % 100).cast("string").alias("z"),
    )
    by_y, by_z = {"x": "ra", "y": "rb"}, {"x": "ra", "z": "rb"}
    assert narrow_to_keys(big, [by_y], rare, work).count() == 180
    both = narrow_to_keys(big, [by_y, by_z], rare, work)
    assert both.columns == big.columns
    assert rows(both) == rows(big.where("x = 'a' and (y = '1' or z = '1')"))


def test_narrowing_plans_alike_at_every_size(spark, work, monkeypatch):
    """The logical plan and the number of stored tables do not depend on the size of the rare side."""
    big = spark.range(5000).select(F.col("id").cast("string").alias("x"))
    seen = []
    for count in (3, 4000):
        stores = []

        def store(df, name="table", stores=stores, keep=work.store):
            plan = df._jdf.queryExecution().optimizedPlan()
            stores.append((name, re.findall(r"Join \w+|Aggregate|Filter", plan.toString())))
            return keep(df, name)

        monkeypatch.setattr(work, "store", store)
        rare = spark.range(count).select(F.col("id").cast("string").alias("r"))
        assert narrow_to_keys(big, [{"x": "r"}], rare, work).count() == count
        monkeypatch.undo()
        seen.append(stores)
    assert seen[0] == seen[1]


def test_work_folder(spark, tmp_path):
    df = spark.range(10).where("id > 3")
    with WorkDir(spark, str(tmp_path)) as work:
        kept = work.store(df)
        assert kept.count() == 6
        assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
        other = work.store(df, "other")
        work.drop(other)
        assert kept.count() == 6 and len(list(tmp_path.glob("*/*"))) == 1
    assert not list(tmp_path.iterdir())
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            WorkDir(spark)


def test_novelty_joins_the_aggregate_when_the_baseline_is_large(spark):
    """A hot caller must reach a shuffled novelty join as aggregated rows."""
    calls = spark.range(1000).select(
        F.lit("u").alias("actor"), F.lit("m").alias("method"), (F.col("id") % 3).cast("string").alias("ip"), "id"
    )
    reduced = calls.groupBy("actor", "method", "ip").agg(F.max("id").alias("latest"))
    baseline = calls.where("id < 2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        novel = novel_vs_baseline(reduced, baseline, ["actor", "method"], "ip")
        assert [(r["ip"], r["latest"]) for r in novel.collect()] == [("2", 998)]
        plan = novel._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("LeftAnti") < plan.index("Aggregate")


def test_skewed_lookup_join_is_split(spark, eager_skew_join):
    """The adaptive skew join splits a key that holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("string")
    df = spark.range(0, 60000, 1, 8).select(
        "id", key.alias("ip"), F.lit("m").alias("m"), (F.expr("timestamp_ntz'2024-01-01'") + span(1, "SECOND") * F.col("id")).alias("t")
    )
    lookup = spark.range(0, 60000, 2).select(F.col("id").cast("string").alias("ip"), F.lit("m").alias("m"))
    hot = lookup.where("ip < '5'").unionByName(spark.sql("select '-1' as ip, 'm' as m"))
    hot_matches = hot.join(df.select("ip"), "ip", "left_semi").count() - 1 + 20000
    for joined, expected in (
        (exclude_known(df, "ip", lookup, "ip"), 40000),
        (keep_known(df, "ip", hot, "ip"), hot_matches),
        (flag_known(df, "ip", lookup, "ip", "known").where("not known"), 40000),
        (novel_vs_baseline(df, lookup, ["ip"], "m"), 40000),
        (first_seen_flag(df, ["ip"], "t", ["id"], "first").where("not first"), 19999),
    ):
        assert joined.count() == expected
        assert "skew=true" in final_plan(joined)
