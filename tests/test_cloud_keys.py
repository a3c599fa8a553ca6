from __future__ import annotations

from datetime import datetime

from tests.conftest import final_plan
from tripline.plans import delegation_with_key_origin, key_creation_burst, plaintext_key_files

AS_OF = "2024-02-01 00:00:00"
CREATE = "google.iam.admin.v1.CreateServiceAccountKey"


def key(time, account, caller="c", **changes):
    return {
        "event_time": time, "project_id": "p", "principal_email": caller, "caller_ip": "1.1.1.1",
        "caller_user_agent": "ua", "service_name": "iam.googleapis.com", "method_name": CREATE,
        "resource": {"labels": {"unique_id": account}} if account else {},
        "proto_payload": {
            "request": {"private_key_type": 2},
            "response": {"key_type": 1, "key_origin": 2, "valid_before_time": {"seconds": 253402300799}},
        }, **changes,
    }


def test_key_creation_burst(table):
    rows = [key(f"2024-01-10 10:{m}:00", "1", "three") for m in ("00", "10", "59")]
    rows += [key(f"2024-01-10 10:{m}:00", "1", "two events") for m in ("00", "10")]
    rows += [key("2024-01-10 10:00:00", a, "two accounts") for a in ("2", "1")]
    rows += [key(t, "1", "over the hour") for t in ("2024-01-10 10:58:00", "2024-01-10 10:59:00", "2024-01-10 11:00:00")]
    rows += [key("2023-12-03 00:00:00", str(n), "too old") for n in range(5)]  # exactly 60 days
    rows += [key("2024-01-10 10:00:00", str(n), "other method", method_name="a.ListKeys") for n in range(5)]
    rows += [key("2024-01-10 10:00:00", str(n), "short name", method_name="CreateServiceAccountKey") for n in range(2)]
    odd = {"request": {"private_key_type": 9}, "response": {"key_type": 0, "key_origin": "x"}}
    rows += [key("2024-01-10 10:00:00", None, "no documents", proto_payload=p) for p in (odd, odd, odd)]
    found = {row["gcp_caller_email"]: row for row in key_creation_burst(table("gcp_audit", rows), AS_OF).collect()}
    assert set(found) == {"three", "two accounts", "short name", "no documents"}
    three = found["three"]
    assert (three["counter"], three["distinct_service_accounts"]) == (3, 1)
    assert (three["earliest"].minute, three["latest"].minute, three["tumble_hour"].minute) == (0, 59, 0)
    assert three["strip_method_name"] == "CreateServiceAccountKey"
    assert three["sa_expiration_date"] == datetime(9999, 12, 31, 23, 59, 59)
    assert three["sa_private_key_type"] == ["GOOGLE_CREDENTIALS_FILE"]
    assert three["sa_key_management_config"] == ["USER_MANAGED"] and three["sa_key_origin"] == ["GOOGLE_PROVIDED"]
    assert found["two accounts"]["service_account_oauth_client_ids"] == ["1", "2"]
    bare = found["no documents"]
    assert (bare["counter"], bare["distinct_service_accounts"], bare["sa_expiration_date"]) == (3, 0, None)
    assert (bare["sa_private_key_type"], bare["sa_key_management_config"], bare["sa_key_origin"]) == (
        [], ["KEY_TYPE_UNSPECIFIED"], [],
    )


def grant(time, client, **changes):
    return {
        "id_time": time, "id_application_name": "admin", "actor_email": "a", "event_type": "DOMAIN_SETTINGS",
        "event_name": "AUTHORIZE_API_CLIENT_ACCESS",
        "event_parameters": {"API_CLIENT_NAME": client, "API_SCOPES": "s", "DOMAIN_NAME": "d"}, **changes,
    }


def test_delegation_with_key_origin(work, table):
    grants = [
        grant("2024-01-20 00:01:00", "100"),
        grant("2024-01-20 00:01:00", "200"),  # no key
        grant("2024-01-20 00:01:00", "app100"),
        grant("2024-01-20 00:01:00", "100", event_name="REMOVE_API_CLIENT_ACCESS"),
        grant("2024-01-20 00:01:00", "100", id_application_name="token"),
        grant("2024-01-20 00:01:00", "100", event_type="X"),
        grant("2023-11-03 00:00:00", "100"),  # exactly 90 days
    ]
    keys = [
        key("2024-01-19 23:59:00", "100"),
        key("2024-01-21 12:00:00", "100", caller_ip="2.2.2.2"),  # after the grant
        key("2024-01-21 12:00:00", "100", caller_ip="3.3.3.3", service_name="other"),
        key("2023-11-03 00:00:00", "100", caller_ip="4.4.4.4"),
        key("2024-01-01 00:00:00", None),
    ]
    ips = [
        {"ip": "2.2.2.2", "specific_source_type": "endpoint_ip_mapping"},
        {"ip": "2.2.2.2", "specific_source_type": "endpoint_ip_mapping"},
        {"ip": "1.1.1.1", "specific_source_type": "vpn"},
        {"ip": None, "specific_source_type": "endpoint_ip_mapping"},
    ]
    result = delegation_with_key_origin(
        table("gsuite_activity", grants), table("gcp_audit", keys), table("org_ip", ips), AS_OF, work
    )
    found = {
        (r["identity_object_gsw"], r["sa_creation_caller_ip"], r["sa_key_state"], r["known_organization_ip"],
         r["day_diff_btw_dt_kc"])
        for r in result.collect()
    }
    assert found == {
        ("100", "1.1.1.1", "first_key_for_sa", False, 1),
        ("100", "2.2.2.2", "new_key_for_existing_sa", True, -1),
        ("200", None, None, None, None),
    }
    assert result.columns == [
        "delegation_time", "actor_email", "event_name", "identity_object_gsw", "api_type", "api_scopes",
        "domain_name", "key_creation_time", "gcp_caller_email", "sa_creation_caller_ip", "known_organization_ip",
        "sa_creation_user_agent", "sa_key_state", "gcp_project_id", "day_diff_btw_dt_kc",
    ]


def test_plaintext_key_files(table):
    names = [
        "proj-abcdefghijkl.json", "proj-abcdefghijk.json", "proj-abcdefghijklm.json", "proj-ABCDEFGHIJKL.json",
        "none-abcdefghijkl.json", "a-b-c-0123456789ab.json", "proj-abcdefghijkl_json", "old-abcdefghijkl.json", None,
    ]
    files = [
        {"event_time": "2024-01-30 00:00:00", "target_file_name": n, "target_file_extension": "json"} for n in names
    ]
    files += [
        {"event_time": "2024-01-30 00:00:00", "target_file_name": names[0], "target_file_extension": "JSON"},
        {"event_time": "2024-01-12 00:00:00", "target_file_name": names[0], "target_file_extension": "json"},
        {"event_time": "2024-01-30 00:00:01", "target_file_name": names[0], "target_file_extension": "json"},
    ]
    audit = [{"event_time": "2024-01-31 00:00:00", "project_id": p} for p in ("proj", "proj", "a-b-c", None)]
    audit += [{"event_time": "2024-01-12 00:00:00", "project_id": "old"}]  # exactly 20 days
    result = plaintext_key_files(table("edr_file", files), table("gcp_audit", audit), AS_OF)
    assert sorted(row["target_file_name"] for row in result.collect()) == [names[5], names[0], names[0]]
    assert len(result.columns) == 11
    plan = final_plan(result)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
