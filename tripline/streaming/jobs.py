"""Detections over a log that keeps growing.

They find what their batch forms find, an hour at a time, once the watermark
has passed it. Events without a time and late ones are left out; late ones are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.timeops import HOUR
from tripline.plans.object_store import (
    BULK_DELETE,
    DELETION_KEYS,
    WRITE_KEYS,
    deletions_from_outside,
    writes_with_foreign_keys,
)
from tripline.streaming.bursts import burst_stream


def _outcomes() -> dict:
    return {"successful_attempts": (~F.col("failed")).cast("int"), "failed_attempts": F.col("failed").cast("int")}


def object_deletion_burst_stream(
    cloudtrail: DataFrame, org_ips: DataFrame, lateness: int, min_objects: int = 20, unique: list[str] | None = None
) -> DataFrame:
    """Streaming ``object_deletion_burst``; ``org_ips`` is a plain table, read for every batch."""
    found = burst_stream(
        deletions_from_outside(cloudtrail, org_ips),
        "event_time",
        DELETION_KEYS,
        HOUR,
        lateness,
        _outcomes(),
        {"object_count": "object_key"},
        (F.col("object_count") > min_objects) | (F.col("event_name") == BULK_DELETE),
        unique=unique,
    )
    return found.select("start_time", "end_time", *DELETION_KEYS, "successful_attempts", "failed_attempts", "object_count")


def foreign_kms_encryption_stream(
    cloudtrail: DataFrame, own_accounts: Sequence[str], lateness: int, unique: list[str] | None = None
) -> DataFrame:
    """Streaming ``foreign_kms_encryption``."""
    found = burst_stream(
        writes_with_foreign_keys(cloudtrail, own_accounts),
        "event_time",
        WRITE_KEYS,
        HOUR,
        lateness,
        _outcomes(),
        {"object_count": "object_key"},
        unique=unique,
    )
    return found.select("start_time", "end_time", *WRITE_KEYS, "successful_attempts", "failed_attempts", "object_count")
