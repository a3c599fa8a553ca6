"""What reaches the Parquet scan of a stored log."""

from __future__ import annotations

import pytest

from checks.views import spark_view
from tests.conftest import SF_DIR
from tripline import plans


@pytest.fixture(scope="module")
def stored_log(spark, tmp_path_factory):
    def build(view: str):
        path = str(tmp_path_factory.mktemp(view) / "log")
        spark_view(spark, SF_DIR, view).write.parquet(path)
        return spark.read.parquet(path)

    return build


def scan_of(df) -> str:
    # Long column lists are cut by default.
    session = df.sparkSession
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    session.conf.set("spark.sql.debug.maxToStringFields", "200")
    plan = df._jdf.queryExecution().executedPlan().toString()
    session.conf.unset("spark.sql.maxMetadataStringLength")
    session.conf.unset("spark.sql.debug.maxToStringFields")
    return next(line for line in plan.splitlines() if "FileScan" in line)


def test_documents_are_read_by_path(stored_log):
    """Only the three scalars are read out of the document column, not the document."""
    scan = scan_of(plans.short_lifecycle(stored_log("cloudtrail")))
    assert "request_parameters:struct<0:string,1:int,2:string>" in scan
    assert "EqualTo(event_name,PutBucketLifecycle)" in scan and "EqualTo(event_source,s3.amazonaws.com)" in scan
    assert "object_key" not in scan


def test_look_back_and_columns_reach_the_scan(stored_log):
    log = stored_log("edr_process")
    scan = scan_of(plans.webdav_retrieval_hosts(log, "2024-01-31 00:00:00"))
    assert "GreaterThan(event_time,2024-01-01T00:00)" in scan and "EqualTo(device_platform,WINDOWS)" in scan
    columns = scan.split("ReadSchema: ")[1]
    assert "target_process_hash" not in columns and "initiating_process_commandline" not in columns
    scan = scan_of(plans.hta_children(log, "2024-01-31 00:00:00"))
    assert "GreaterThanOrEqual(event_time,2024-01-01T00:00)" in scan


def test_in_list_reaches_the_scan(stored_log):
    scan = scan_of(plans.foreign_kms_encryption(stored_log("cloudtrail"), ["111111111111"]))
    assert "In(event_name, [CopyObject,CreateMultipartUpload,PutObject])" in scan
    assert "Not(EqualTo(request_kms_key_aws_account,111111111111))" in scan
