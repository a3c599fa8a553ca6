"""Detections over object-storage access logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.docs import doc_get, doc_list
from tripline.functions.predicates import like_raw
from tripline.functions.text import role_of_session
from tripline.functions.timeops import HOUR, time_slice
from tripline.operators.aggs import burst, outcome_counts
from tripline.operators.lookups import exclude_known

# Fixed values of the access log.
SERVICE_HOSTS = "%.amazonaws.com"
STORE = "s3.amazonaws.com"
MANAGED_KEYS = "alias/aws/%"
WRITE_EVENTS = ("CopyObject", "PutObject", "CreateMultipartUpload")
DELETE_EVENTS = ("DeleteObject", "DeleteObjects")
BULK_DELETE = "DeleteObjects"
LIFECYCLE_EVENT = "PutBucketLifecycle"


def _from_outside() -> Column:
    """Not sent by a cloud service. A NULL address is neither, and such rows drop out."""
    return ~like_raw("source_ip_address", SERVICE_HOSTS)


WRITE_KEYS = [
    "event_name",
    "aws_region",
    "source_ip_address",
    "user_agent",
    "user_identity_type",
    "user_identity_arn",
    "bucket_name",
]
DELETION_KEYS = [
    "user_identity_arn",
    "user_identity_type",
    "user_role",
    "user_identity_access_key_id",
    "recipient_account_id",
    "event_name",
    "event_source",
    "source_ip_address",
    "user_agent",
    "bucket_name",
]


def writes_with_foreign_keys(cloudtrail: DataFrame, own_accounts: Sequence[str]) -> DataFrame:
    """Object writes with a customer-managed key of an account that is not ours; ``failed`` tells whether one did."""
    return (
        cloudtrail.where(
            F.col("event_name").isin(*WRITE_EVENTS)
            & _from_outside()
            & ~like_raw("request_kms_key_alias", MANAGED_KEYS)
            & ~F.col("request_kms_key_aws_account").isin(*own_accounts)
        )
        .withColumn("bucket_name", doc_get("request_parameters", "bucketName"))
        .withColumn("failed", F.col("response_kms_key").isNull() | F.col("error_code").isNotNull())
    )


def deletions_from_outside(cloudtrail: DataFrame, org_ips: DataFrame) -> DataFrame:
    """Deletions from addresses that are neither a cloud service's nor the organisation's; ``failed`` tells whether one did."""
    deletions = cloudtrail.where(
        (F.col("event_source") == STORE) & _from_outside() & F.col("event_name").isin(*DELETE_EVENTS)
    )
    return (
        exclude_known(deletions, "source_ip_address", org_ips, "ip")
        .withColumn("user_role", role_of_session("user_identity_type", "user_identity_arn"))
        .withColumn("bucket_name", doc_get("request_parameters", "bucketName"))
        .withColumn("failed", F.col("error_code").isNotNull())
    )


def foreign_kms_encryption(cloudtrail: DataFrame, own_accounts: Sequence[str]) -> DataFrame:
    """Object writes with a customer-managed key of an account that is not ours.

    Per hour, origin and bucket: attempts that succeeded and failed, and the
    number of distinct objects. Events without a key alias or a key account drop out.
    """
    return burst(
        writes_with_foreign_keys(cloudtrail, own_accounts),
        "event_time",
        time_slice("event_time", HOUR),
        WRITE_KEYS,
        [*outcome_counts(F.col("failed")), F.count_distinct("object_key").alias("object_count")],
    ).select("start_time", "end_time", *WRITE_KEYS, "successful_attempts", "failed_attempts", "object_count")


def short_lifecycle(cloudtrail: DataFrame, max_days: int = 7, rule_lists: bool = False) -> DataFrame:
    """Enabled expiry rules of fewer than ``max_days`` days, set by anyone but a cloud service.

    Denied attempts are included. A request may hold one rule or a list of them; only
    the first form has the path that is read by default. With ``rule_lists``
    every rule of a list is a row of its own.
    """
    path = "LifecycleConfiguration.Rule"
    requests = cloudtrail.where(
        (F.col("event_source") == STORE) & _from_outside() & (F.col("event_name") == LIFECYCLE_EVENT)
    )
    if rule_lists:
        requests = requests.withColumn("_rule", F.explode(doc_list("request_parameters", path)))
        rule = lambda name, kind="string": doc_get("_rule", name, kind)
    else:
        rule = lambda name, kind="string": doc_get("request_parameters", f"{path}.{name}", kind)
    return (
        requests.select(
            "event_time",
            "user_identity_arn",
            "user_identity_user_name",
            "user_identity_type",
            role_of_session("user_identity_type", "user_identity_arn").alias("user_role"),
            "user_identity_access_key_id",
            "recipient_account_id",
            "event_name",
            "event_source",
            "source_ip_address",
            "user_agent",
            doc_get("request_parameters", "bucketName").alias("bucket_name"),
            rule("Expiration.Days", "int").alias("expiration_days"),
            rule("Status").alias("status"),
            "error_code",
        )
        .where((F.col("expiration_days") < max_days) & (F.col("status") == "Enabled"))
    )


def object_deletion_burst(cloudtrail: DataFrame, org_ips: DataFrame, min_objects: int = 20) -> DataFrame:
    """Deletions from addresses outside the organisation, per hour and origin.

    Kept are hours with more than ``min_objects`` distinct objects, and every
    hour with a bulk delete, whose object count the log does not tell.
    """
    return burst(
        deletions_from_outside(cloudtrail, org_ips),
        "event_time",
        time_slice("event_time", HOUR),
        DELETION_KEYS,
        [*outcome_counts(F.col("failed")), F.count_distinct("object_key").alias("object_count")],
        (F.col("object_count") > min_objects) | (F.col("event_name") == BULK_DELETE),
    ).select("start_time", "end_time", *DELETION_KEYS, "successful_attempts", "failed_attempts", "object_count")
