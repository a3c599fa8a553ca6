from __future__ import annotations

from tests.conftest import final_plan
from tripline.plans import foreign_kms_encryption, object_deletion_burst, short_lifecycle

HOUR = "2024-01-01 10:"


def deletion(number, **changes):
    return {
        "event_time": f"{HOUR}{number % 60:02d}:00", "event_name": "DeleteObject", "event_source": "s3.amazonaws.com",
        "source_ip_address": "198.18.0.1", "user_agent": "cli", "user_identity_type": "AssumedRole",
        "user_identity_arn": "arn:aws:sts::1:assumed-role/Admin/me", "object_key": f"k{number}",
        "request_parameters": {"bucketName": "b"}, **changes,
    }


def test_events_without_a_time_are_a_group(table):
    rows = [deletion(n, event_time=None) for n in range(21)] + [deletion(n, user_agent="timed") for n in range(21)]
    rows += [deletion(n, user_agent="tag", event_name="DeleteObjectTagging") for n in range(30)]
    found = object_deletion_burst(table("cloudtrail", rows), table("org_ip", [])).collect()
    assert {(r["user_agent"], r["start_time"] is None, r["object_count"]) for r in found} == {
        ("cli", True, 21), ("timed", False, 21)
    }
    write = {
        "event_name": "PutObject", "source_ip_address": "198.18.0.1", "request_kms_key_alias": "alias/x",
        "request_kms_key_aws_account": "999", "object_key": "k", "response_kms_key": "key", "event_time": None,
    }
    encrypted = foreign_kms_encryption(table("cloudtrail", [write]), ("111",)).collect()
    assert [(r["start_time"], r["successful_attempts"]) for r in encrypted] == [(None, 1)]


def test_deletion_burst(table):
    rows = [deletion(n, error_code="AccessDenied" if n < 2 else None) for n in range(21)]
    rows += [deletion(n, user_agent="twenty") for n in range(20)]  # at the limit
    rows += [deletion(n % 20, user_agent="repeats") for n in range(40)]  # 40 events, 20 objects
    rows += [deletion(0, user_agent="bulk", event_name="DeleteObjects", object_key=None)]
    rows += [deletion(n, user_agent="known", source_ip_address="10.0.0.1") for n in range(30)]
    rows += [deletion(n, user_agent="service", source_ip_address="x.amazonaws.com") for n in range(30)]
    rows += [deletion(n, user_agent="no address", source_ip_address=None) for n in range(30)]
    rows += [deletion(n, user_agent="other source", event_source="ec2.amazonaws.com") for n in range(30)]
    rows += [deletion(n, user_agent="read", event_name="GetObject") for n in range(30)]
    rows += [deletion(n, user_agent="two hours", event_time=f"2024-01-01 1{n % 2}:00:00") for n in range(40)]
    rows += [deletion(n, user_agent="user", user_identity_type="IAMUser") for n in range(21)]
    org_ips = table("org_ip", [{"ip": "10.0.0.1"}, {"ip": "10.0.0.1"}, {"ip": None}])
    result = object_deletion_burst(table("cloudtrail", rows), org_ips)
    found = {row["user_agent"]: row for row in result.collect()}
    assert set(found) == {"cli", "bulk", "user"}
    assert (found["cli"]["successful_attempts"], found["cli"]["failed_attempts"]) == (19, 2)
    assert found["cli"]["object_count"] == 21 and found["bulk"]["object_count"] == 0
    assert found["cli"]["user_role"] == "Admin" and found["user"]["user_role"] is None
    assert found["cli"]["bucket_name"] == "b"
    assert str(found["cli"]["start_time"]) == "2024-01-01 10:00:00" and found["cli"]["end_time"].minute == 20
    assert result.columns == [
        "start_time", "end_time", "user_identity_arn", "user_identity_type", "user_role",
        "user_identity_access_key_id", "recipient_account_id", "event_name", "event_source", "source_ip_address",
        "user_agent", "bucket_name", "successful_attempts", "failed_attempts", "object_count",
    ]
    plan = final_plan(result)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def write(number, **changes):
    return {
        "event_time": f"{HOUR}{number:02d}:00", "event_name": "PutObject", "source_ip_address": "198.18.0.1",
        "user_agent": "in", "response_kms_key": "key", "request_kms_key_alias": "alias/mine",
        "request_kms_key_aws_account": "999", "object_key": f"k{number % 3}",
        "request_parameters": {"bucketName": "b"}, **changes,
    }


def test_foreign_key(table):
    rows = [write(0), write(1), write(2, error_code="Denied"), write(3, response_kms_key=None)]
    rows += [write(4, response_kms_key=None, error_code="Denied")]
    rows += [
        write(0, user_agent="own", request_kms_key_aws_account="111"),
        write(0, user_agent="no account", request_kms_key_aws_account=None),
        write(0, user_agent="managed", request_kms_key_alias="alias/aws/s3"),
        write(0, user_agent="no alias", request_kms_key_alias=None),
        write(0, user_agent="service", source_ip_address="a.amazonaws.com"),
        write(0, user_agent="no address", source_ip_address=None),
        write(0, user_agent="read", event_name="GetObject"),
    ]
    rows += [write(0, event_time="2024-01-01 11:00:00"), write(0, request_parameters=None)]
    found = foreign_kms_encryption(table("cloudtrail", rows), ["111", "222"]).collect()
    assert {row["user_agent"] for row in found} == {"in"} and len(found) == 3
    first = next(row for row in found if row["bucket_name"] == "b" and row["start_time"].hour == 10)
    assert (first["successful_attempts"], first["failed_attempts"], first["object_count"]) == (2, 3, 3)


def rule(days, status="Enabled", **changes):
    settings = {"Rule": {"Expiration": {"Days": days}, "Status": status}}
    return {
        "event_source": "s3.amazonaws.com", "event_name": "PutBucketLifecycle", "source_ip_address": "1.1.1.1",
        "request_parameters": {"bucketName": "b", "LifecycleConfiguration": settings}, **changes,
    }


def test_short_lifecycle(table):
    as_list = {"LifecycleConfiguration": {"Rule": [{"Expiration": {"Days": 1}, "Status": "Enabled"}]}}
    rows = [
        rule(6, user_agent="in"),
        rule("6", user_agent="text days"),
        rule(1, user_agent="denied", error_code="AccessDenied"),
        rule(7, user_agent="seven"),
        rule(6, "Disabled", user_agent="disabled"),
        rule(6, user_agent="service", source_ip_address="s3.amazonaws.com"[:2] + ".amazonaws.com"),
        rule(6, user_agent="no address", source_ip_address=None),
        rule(6, user_agent="other event", event_name="PutObject"),
        rule(6, user_agent="other source", event_source="x"),
        rule(6, user_agent="list", request_parameters=as_list),
        rule(6, user_agent="none", request_parameters=None),
        rule("soon", user_agent="no number"),
    ]
    found = short_lifecycle(table("cloudtrail", rows)).collect()
    assert {(r["user_agent"], r["expiration_days"]) for r in found} == {("in", 6), ("text days", 6), ("denied", 1)}
    assert len(found[0]) == 15
    assert short_lifecycle(table("cloudtrail", [rule(8)]), max_days=9).count() == 1


def test_rules_in_lists(table):
    def several(*rules, agent):
        return rule(1, user_agent=agent, request_parameters={"bucketName": "b", "LifecycleConfiguration": {"Rule": list(rules)}})

    short, off = {"Expiration": {"Days": 2}, "Status": "Enabled"}, {"Expiration": {"Days": 2}, "Status": "Disabled"}
    rows = [
        several(short, off, {"Status": "Enabled"}, {"Expiration": {"Days": 3}, "Status": "Enabled"}, agent="four"),
        several(agent="none"),
        several("text", 7, None, short, agent="odd"),
        rule(6, user_agent="single"),
        rule(6, user_agent="nothing", request_parameters=None),
    ]
    found = short_lifecycle(table("cloudtrail", rows), rule_lists=True).collect()
    assert sorted((r["user_agent"], r["expiration_days"]) for r in found) == [("four", 2), ("four", 3), ("odd", 2), ("single", 6)]
    assert len(found[0]) == 15 and {r["bucket_name"] for r in found if r["user_agent"] == "four"} == {"b"}
    assert [r["user_agent"] for r in short_lifecycle(table("cloudtrail", rows)).collect()] == ["single"]
