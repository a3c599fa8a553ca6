"""The streaming forms over the events table, delivered in several runs, with their oracles.

The events arrive by thirds of their time range; every ninth one arrives a run
later than it should and every thirteenth one arrives twice. After each run
the stream stops and the next one goes on from its checkpoint. The last run
also brings heartbeats, events of no user far in the future, that let the
watermark pass everything before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.jobs import FOREIGN_KMS_ENCRYPTION, OBJECT_DELETION_BURST, OWN_ACCOUNTS
from checks.operators import INTERVAL_JOIN_INNER, INTERVAL_JOIN_LEFT
from checks.views import spark_view
from tripline.functions.timeops import as_ntz, epoch_seconds
from tripline.operators.workdir import WorkDir
from tripline.sources import conform
from tripline.streaming import (
    Drained,
    burst_stream,
    drain,
    first_seen_stream,
    foreign_kms_encryption_stream,
    interval_join_stream,
    object_deletion_burst_stream,
)
from tripline.streaming.first_seen import STATE_STORE

RUNS = 4
DAY = 86400
#: A delay that makes some events late, and one that no event exceeds.
SHORT, LONG = 3 * DAY, 12 * DAY
_FIRST, _HEARTBEAT = "2024-01-01 00:00:00", "2030-01-01 00:00:00"


def _deliveries(spark: SparkSession, sf_dir: str, heartbeats: list[str | None]) -> DataFrame:
    """Events with the run that brings them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    third = F.least(F.floor((epoch_seconds("ts") - epoch_seconds(as_ntz(_FIRST))) / (10 * DAY)), F.lit(2))
    copies = F.when(F.col("event_id") % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    arriving = events.withColumn("run", (third + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)).cast("int"))
    arriving = arriving.withColumn("copy", F.explode(copies)).drop("copy")
    last = spark.createDataFrame([(kind,) for kind in heartbeats], "event_type string").select(
        F.lit(None).cast("long").alias("event_id"), as_ntz(_HEARTBEAT).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        "event_type", F.lit(RUNS - 1).alias("run"),
    )
    return arriving.unionByName(last)


def _run(
    spark: SparkSession,
    sf_dir: str,
    form: Callable[[DataFrame], DataFrame],
    heartbeats: list[str | None],
    state_store: dict[str, str] | None = None,
) -> tuple[DataFrame, list[Drained]]:
    """All the stream's output and what each run did."""
    work = WorkDir.for_session(spark)
    landing, out, checkpoint = (work.new_path(name) for name in ("landing", "found", "checkpoint"))
    deliveries = work.store(_deliveries(spark, sf_dir, heartbeats), "deliveries")
    arriving = deliveries.drop("run")
    runs = []
    for number in range(RUNS):
        deliveries.where(F.col("run") == number).drop("run").write.mode("append").parquet(landing)
        stream = form(spark.readStream.schema(arriving.schema).parquet(landing))
        runs.append(drain(stream, out, checkpoint, state_store))
    return spark.read.schema(stream.schema).parquet(out), runs


def _bursts(events: DataFrame) -> DataFrame:
    return burst_stream(
        events, "ts", ["user_id"], 3600, SHORT, {"counter": F.lit(1)}, {"types": "event_type"},
        (F.col("counter") > 2) | (F.col("types") > 1), unique=["event_id"],
    )


def hour_burst_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _bursts, [None])[0]


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run read and found to be late."""
    _, runs = _run(spark, sf_dir, _bursts, [None])
    return spark.createDataFrame([(n, run.rows, run.late) for n, run in enumerate(runs)], "run int, read long, late long")


_ARRIVED = f"""
WITH arrived AS (
    SELECT *, CAST(least(floor(epoch(ts - TIMESTAMP '{_FIRST}') / {10 * DAY}), 2) + if(event_id % 9 = 0, 1, 0) AS INTEGER) AS run,
           if(event_id % 13 = 0, 2, 1) AS copies
    FROM events),
marks AS (SELECT run, max(max(ts)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
          FROM arrived GROUP BY run),
marked AS (SELECT *, date_trunc('millisecond', latest) - INTERVAL {SHORT} SECOND AS mark FROM arrived JOIN marks USING (run))
"""

HOUR_BURST_STREAM = f"""{_ARRIVED}
SELECT date_trunc('hour', ts) AS bucket, user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS counter,
       count(DISTINCT event_type) AS types
FROM marked WHERE mark IS NULL OR ts > mark
GROUP BY ALL HAVING count(*) > 2 OR count(DISTINCT event_type) > 1
"""

LATE_EVENTS = f"""{_ARRIVED}
SELECT run, CAST(sum(copies) + if(run = {RUNS - 1}, 1, 0) AS BIGINT) AS read,
       CAST(coalesce(sum(copies) FILTER (WHERE ts <= mark), 0) AS BIGINT) AS late
FROM marked GROUP BY run
"""


def _purchases_after_signups(how: str) -> Callable[[DataFrame], DataFrame]:
    def form(events: DataFrame) -> DataFrame:
        signups = events.where(F.col("event_type") == "signup").select(
            "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_time")
        )
        purchases = events.where(F.col("event_type") == "purchase").select(
            F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_time")
        )
        return interval_join_stream(
            signups, purchases, {"user_id": "buyer"}, "signup_time", "purchase_time", 0, 6 * 3600, LONG, how
        )

    return form


def _joined(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Pairs without those that events delivered twice repeat."""
    found, _ = _run(spark, sf_dir, _purchases_after_signups(how), ["signup", "purchase"])
    return found.where(F.col("signup_id").isNotNull()).distinct()


def interval_join_stream_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "inner")


def interval_join_stream_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "left")


def _new_interests(events: DataFrame) -> DataFrame:
    return first_seen_stream(events, ["user_id", "event_type"], "ts", ["event_id"], SHORT, silence=DAY)


def first_seen_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _run(spark, sf_dir, _new_interests, [None], STATE_STORE)
    return found.where(F.col("ts") < as_ntz(_HEARTBEAT))


FIRST_SEEN_STREAM = f"""{_ARRIVED}
SELECT user_id, event_type, ts, event_id
FROM marked WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark
QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > INTERVAL {DAY} SECOND, true)
"""

def _new_tuples(events: DataFrame) -> DataFrame:
    placed = events.withColumn("place", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3))
    return first_seen_stream(placed, ["user_id", "event_type", "place"], "ts", ["event_id"], LONG)


def novelty_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples that were not seen in the first twelve days; what is known is the state."""
    found, _ = _run(spark, sf_dir, _new_tuples, [None], STATE_STORE)
    return found.where(F.col("ts").between(as_ntz("2024-01-12 00:00:00"), as_ntz("2025-01-01 00:00:00")))


NOVELTY_STREAM = """
SELECT user_id, event_type, place, ts, event_id
FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 END AS place FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, place ORDER BY ts, event_id) = 1
    AND ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2025-01-01'
"""


def _over_access_log(
    spark: SparkSession, sf_dir: str, form: Callable[[DataFrame], DataFrame], heartbeat: dict[str, str]
) -> DataFrame:
    """All output of a stream over the access log, stored as it arrives in two halves with its documents as JSON text."""
    work = WorkDir.for_session(spark)
    landing, out, checkpoint = (work.new_path(name) for name in ("landing", "found", "checkpoint"))
    log = spark_view(spark, sf_dir, "cloudtrail").withColumn("request_parameters", F.to_json("request_parameters"))
    log = work.store(log, "log")
    middle = log.agg(F.percentile_approx(epoch_seconds("event_time"), 0.5)).first()[0]
    first = F.coalesce(epoch_seconds("event_time") <= middle, F.lit(True))
    beat = spark.range(1).select(
        *[F.lit(heartbeat.get(name)).cast(log.schema[name].dataType).alias(name) for name in log.columns if name != "event_time"],
        as_ntz(_HEARTBEAT).alias("event_time"),
    )
    for arriving in (log.where(first), log.where(~first).unionByName(beat)):
        arriving.write.mode("append").parquet(landing)
        stream = form(conform(spark.readStream.schema(log.schema).parquet(landing), "cloudtrail"))
        drain(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def object_deletion_burst_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    org_ips = spark_view(spark, sf_dir, "org_ip")
    beat = {"event_name": "DeleteObject", "event_source": "s3.amazonaws.com", "source_ip_address": "heartbeat"}
    return _over_access_log(spark, sf_dir, lambda log: object_deletion_burst_stream(log, org_ips, DAY), beat)


def foreign_kms_encryption_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = {
        "event_name": "PutObject", "source_ip_address": "heartbeat", "request_kms_key_alias": "alias/other",
        "request_kms_key_aws_account": "999999999999",
    }
    return _over_access_log(spark, sf_dir, lambda log: foreign_kms_encryption_stream(log, OWN_ACCOUNTS, DAY), beat)


def _timed(sql: str) -> str:
    """The batch oracle without the events that have no time."""
    return sql.replace("FROM cloudtrail", "FROM (SELECT * FROM cloudtrail WHERE event_time IS NOT NULL) AS cloudtrail")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "hour_burst_stream": (hour_burst_stream, HOUR_BURST_STREAM),
    "late_events": (late_events, LATE_EVENTS),
    "interval_join_stream_inner": (interval_join_stream_inner, INTERVAL_JOIN_INNER),
    "interval_join_stream_left": (interval_join_stream_left, INTERVAL_JOIN_LEFT),
    "first_seen_stream": (first_seen_stream_query, FIRST_SEEN_STREAM),
    "novelty_stream": (novelty_stream, NOVELTY_STREAM),
    "object_deletion_burst_stream": (object_deletion_burst_live, _timed(OBJECT_DELETION_BURST)),
    "foreign_kms_encryption_stream": (foreign_kms_encryption_live, _timed(FOREIGN_KMS_ENCRYPTION)),
}
