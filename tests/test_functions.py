from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripline.functions.docs import decode_codes, doc_get, with_documents
from tripline.functions.predicates import full_match, ilike_any, ilike_raw, is_internal_host, like_raw
from tripline.functions.text import last_part, part, remote_host, role_of_session
from tripline.functions.timeops import (
    DayFolders,
    as_ntz,
    days_between,
    epoch_seconds,
    from_epoch_seconds,
    recent,
    span,
    time_slice,
    utc_ntz,
    within,
)


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "pattern", "fits"),
    [
        (r"c:\users\public\a", r"%users\public%", True),
        (r"c:\users%public", r"%users\public%", False),
        (r"a\b%c", r"a\b%c", True),
        (r"wscript.exe \\h@80\x.jse", r"%wscript.exe%\%@%\%.jse%", True),
        (r"wscript.exe \\h\x.jse", r"%wscript.exe%\%@%\%.jse%", False),
        ("a~b", "a~_", True),
        ("ab", "a~_", False),
    ],
)
def test_like_takes_a_backslash_literally(value, text, pattern, fits):
    assert value(like_raw(F.lit(text), pattern)) is fits
    assert value(ilike_raw(F.lit(text.upper()), pattern)) is fits


def test_like_on_null_is_null(value):
    missing = F.lit(None).cast("string")
    assert value(~like_raw(missing, "%a")) is None
    assert value(ilike_any(missing, ("%a", "%b"))) is None


def test_ilike_any(value):
    assert value(ilike_any(F.lit("new ACTIVEXobject"), ("%http%", "%ActiveXObject%")))
    assert not value(ilike_any(F.lit("nothing"), ("%http%", "%ActiveXObject%")))


def test_all_escape_characters_used_up():
    with pytest.raises(ValueError, match="escape"):
        like_raw(F.lit("x"), "~^!#")


def test_full_match_covers_the_whole_text(value):
    assert value(full_match(F.lit("123"), "[0-9]+"))
    assert not value(full_match(F.lit("123\n"), "[0-9]+"))
    assert not value(full_match(F.lit("a123"), "[0-9]+"))
    assert value(full_match(F.lit("b"), "a|b"))


@pytest.mark.parametrize(
    ("host", "internal"),
    [
        ("10.1.2.3", True), ("11.0.0.1", False), ("192.168.0.1", True), ("192.169.0.1", False), ("127.0.0.1", True),
        ("172.15.0.1", False), ("172.16.0.1", True), ("172.31.0.1", True), ("172.32.0.1", False),
        ("172.160.0.1", False), ("169.254.1.1", True), ("0.0.0.0", True), ("100.63.0.1", False),
        ("100.64.0.1", True), ("100.99.0.1", True), ("100.127.0.1", True), ("100.128.0.1", False),
        ("192.0.0.8", True), ("192.0.2.8", True), ("192.0.3.8", False), ("192.88.99.1", True),
        ("198.17.0.1", False), ("198.18.0.1", True), ("198.19.0.1", True), ("198.20.0.1", False),
        ("198.51.100.4", True), ("203.0.113.4", True), ("233.252.0.1", True), ("223.0.0.1", False),
        ("224.0.0.1", True), ("239.1.1.1", True), ("240.1.1.1", True), ("255.255.255.255", True),
        ("256.1.1.1", False), ("fc00::1.x", True), ("fe80.local", True), ("ff00.x", True),
        ("localhost", True), ("localhost:80", True), ("localhost.example.com", False), ("files.example.com", False),
        ("10x.example.com", False), ("x10.1.1.1", False),
    ],
)
def test_internal_hosts(value, host, internal):
    assert value(is_internal_host(F.lit(host))) is internal


def test_recent_edge_is_open_or_closed(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 00:00:00.000001",), ("2023-12-31 23:59:59",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert recent(df, "t", 30, "2024-01-31").count() == 1
    assert recent(df, "t", 30, datetime(2024, 1, 31), inclusive=True).count() == 2


def test_within_is_closed(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t union all select timestamp_ntz'2024-01-02 00:00:01'")
    assert within(df, "t", "2024-01-01", "2024-01-02").count() == 1


def test_look_back_prunes_day_folders(spark, tmp_path):
    days = spark.range(10).select(
        (as_ntz("2024-01-01 12:00:00") + F.col("id") * span(1, "DAY")).alias("t"), F.col("id").alias("n")
    )
    days.withColumn("event_date", F.to_date("t")).write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    folders = DayFolders("event_date", margin_days=1)
    kept = recent(folders.since(log, "2024-01-09 00:00:00"), "t", 2, "2024-01-11 00:00:00")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(event_date" in plan and "PushedFilters: [IsNotNull(t), GreaterThan" in plan
    assert sorted(row["n"] for row in kept.collect()) == [8, 9]
    assert len(folders.since(log, "2024-01-09 00:00:00").inputFiles()) == len(log.inputFiles())
    assert folders.until(folders.since(log, "2024-01-03"), "2024-01-04 23:00:00").count() == 4
    assert within(log, "t", "2024-01-03 00:00:00", "2024-01-04 23:00:00").count() == 2


def test_look_back_keeps_rows_of_other_folders(spark, tmp_path):
    """A row without a day, or in the folder of the day before or after, is judged by its event time."""
    rows = [("2024-01-10 12:00:00", None), ("2024-01-09 00:00:01", "2024-01-08"), ("2024-01-10 23:59:00", "2024-01-11"),
            ("2024-01-08 23:59:59", "2024-01-08")]
    df = spark.createDataFrame(rows, "t string, event_date string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("t"), F.col("event_date").cast("date").alias("event_date"))
    df.write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert recent(log, "t", 2, "2024-01-11").count() == 3
    assert recent(DayFolders().since(log, "2024-01-09"), "t", 2, "2024-01-11").count() == 3
    assert recent(DayFolders(margin_days=0).since(log, "2024-01-09"), "t", 2, "2024-01-11").count() == 2


def test_slices(value):
    time = as_ntz("2024-01-01 00:00:59.999999")
    assert value(time_slice(time, 5)) == datetime(2024, 1, 1, 0, 0, 55)
    assert value(time_slice(as_ntz("2024-01-01 00:05:00"), 300)) == datetime(2024, 1, 1, 0, 5)
    assert value(time_slice(as_ntz("1969-12-31 23:59:58"), 5)) == datetime(1969, 12, 31, 23, 59, 55)
    assert value(time_slice(F.lit(None).cast("timestamp_ntz"), 5)) is None


def test_days_count_midnights(value):
    assert value(days_between(as_ntz("2024-01-01 23:59:00"), as_ntz("2024-01-02 00:01:00"))) == 1
    assert value(days_between(as_ntz("2024-01-01 00:00:00"), as_ntz("2024-01-01 23:59:59"))) == 0
    assert value(days_between(as_ntz("2024-01-03"), as_ntz("2024-01-01 12:00:00"))) == -2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_seconds_ignore_the_session_zone(spark, value, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert value(from_epoch_seconds(F.lit(253402300799))) == datetime(9999, 12, 31, 23, 59, 59)
        assert value(from_epoch_seconds(F.lit(1710054000))) == datetime(2024, 3, 10, 7, 0)
        assert value(from_epoch_seconds(F.lit(-1))) == datetime(1969, 12, 31, 23, 59, 59)
        assert value(from_epoch_seconds(F.lit(10**17))) is None
        assert value(epoch_seconds(as_ntz("2024-03-10 02:30:00.9"))) == 1710037800
        assert value(time_slice(as_ntz("2024-03-10 02:30:04"), 3600)) == datetime(2024, 3, 10, 2)
        for micros in (1710054000123456, -1, 0, 1710037800000000):
            instant = F.timestamp_micros(F.lit(micros))
            assert value(utc_ntz(instant)) == datetime(1970, 1, 1) + timedelta(microseconds=micros)
        assert value(utc_ntz(F.lit(None).cast("timestamp"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_documents(spark):
    text = '{"a": {"b": {"c": "7"}}, "A": 1, "list": [{"x": 5}], "n": null, "f": true}'
    df = with_documents(spark.createDataFrame([(text,), ("not json",), (None,)], "d string"), "d")
    rows = df.select(
        doc_get("d", "a.b.c", "int").alias("deep"),
        doc_get("d", "a.b.c").alias("text"),
        doc_get("d", "A", "int").alias("upper"),
        doc_get("d", "a.B.c").alias("case"),
        doc_get("d", "list.x").alias("array"),
        doc_get("d", "n").alias("null"),
        doc_get("d", "f", "int").alias("other"),
        doc_get("d", "gone.too").alias("gone"),
    ).collect()
    assert tuple(rows[0])[:6] == (7, "7", 1, None, None, None) and rows[0]["gone"] is None
    assert set(rows[1]) == {None} and set(rows[2]) == {None}


def test_decode_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "c int")
    labels = decode_codes(F.col("c"), ("a", "b", "c"))
    assert [row[0] for row in df.select(labels).collect()] == ["a", "b", "c", None, None]


def test_text_parts(value):
    assert value(last_part(F.lit("a.b.c"), ".")) == "c"
    assert value(last_part(F.lit("plain"), ".")) == "plain"
    assert value(part(F.lit("a/b"), "/", 5)) == ""
    assert value(remote_host(F.lit("x HTTP://Host.Example/p//q"))) == "host.example"
    assert value(remote_host(F.lit("no host"))) == ""
    assert value(role_of_session(F.lit("AssumedRole"), F.lit("arn:x/role/session"))) == "role"
    assert value(role_of_session(F.lit("IAMUser"), F.lit("arn:x/role/session"))) is None
