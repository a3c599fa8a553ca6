from __future__ import annotations

import pytest

from tests.conftest import final_plan
from tests.test_cloud_keys import grant
from tripline.plans import inactive_delegations, novel_api_calls

AS_OF = "2024-02-01 00:00:00"


def call(time, actor, ip, method, **changes):
    return {
        "id_time": time, "id_application_name": "token", "event_name": "activity", "actor_email": actor,
        "ip_address": ip,
        "event_parameters": {"client_id": "c", "method_name": method, "app_name": "123"}, **changes,
    }


def test_novel_api_calls(table):
    learnt, later = "2023-08-01 00:00:00", "2023-10-01 00:00:00"
    rows = [
        call("2023-07-01 00:00:00", "edge", "1", "m"),
        call("2023-09-01 00:00:00", "edge", "2", "m"),
        call("2023-09-01 00:00:01", "edge", "3", "m"),
        call(later, "edge", "1", "m"),
        call(learnt, "a", "1", "m"),
        call(later, "a", "1", "m"),
        call(later, "a", "2", "m"),
        call("2023-10-02 00:00:00", "a", "3", "m"),
        call(later, "a", None, "m"),  # known actor and method
        call(later, "a", None, "new"),
        call(learnt, "b", None, "m"),  # a missing address is not learnt
        call(later, None, "1", "m"),  # could be a known actor
        call(learnt, None, "77", "q"),
        call(later, "b", "77", "q"),  # could be the learned call without an actor
        call(later, "app", "9", "m", event_parameters={"client_id": "c", "method_name": "m", "app_name": "mail"}),
        call(later, "drive", "9", "m", id_application_name="drive"),
        call(later, "view", "9", "m", event_name="view"),
        # Learnt through a marketplace app, then called by a service account: known.
        call(learnt, "mixed", "1", "m", event_parameters={"client_id": "c", "method_name": "m", "app_name": "mail"}),
        call(later, "mixed", "1", "m"),
    ]
    result = novel_api_calls(table("gsuite_activity", rows))
    found = {(r["actor_email"], r["method_name"]): r for r in result.collect()}
    assert set(found) == {("edge", "m"), ("a", "m"), ("a", "new"), ("b", "m")}
    assert found["edge", "m"]["source_ips"] == ["3"]
    assert found["a", "m"]["source_ips"] == ["2", "3"] and found["a", "new"]["source_ips"] == []
    assert (found["a", "m"]["earliest"].day, found["a", "m"]["latest"].day) == (1, 2)
    assert found["a", "m"]["api_type"] == "SA_TYPE" and found["a", "m"]["client_id"] == "c"
    plan = final_plan(result)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture
def activity(table):
    revoke = {"event_name": "REMOVE_API_CLIENT_ACCESS"}
    rows = [
        grant("2024-01-01 00:00:00", "1"),
        grant("2024-01-02 00:00:00", "2"),
        grant("2024-01-03 00:00:00", "2", **revoke),
        grant("2024-01-02 00:00:00", "3", **revoke),
        grant("2024-01-01 00:00:00", "3"),
        grant("2024-01-03 00:00:00", "3", actor_email="again"),
        grant("2024-01-01 00:00:00", "app"),
        grant("2023-04-07 00:00:00", "4"),  # exactly 300 days
        grant("2024-01-01 00:00:00", "5", event_type="X"),
    ]
    for time in ("2024-01-20 00:00:00", "2024-01-31 23:59:00"):
        rows.append(call(time, "x", "1", "m", event_parameters={"client_id": "3"}))
    rows.append(call("2023-04-07 00:00:00", "x", "1", "m", event_parameters={"client_id": "1"}))
    # Calls are counted whatever application reports them.
    rows.append(call("2024-01-05 00:00:00", "x", "1", "m", event_parameters={"client_id": "3"}, id_application_name="z"))
    return table("gsuite_activity", rows)


def test_inactive_delegations(activity):
    found = {r["oauth_client_id"]: r for r in inactive_delegations(activity, AS_OF).collect()}
    assert set(found) == {"1", "3"}
    assert found["3"]["actor_email"] == "again" and found["3"]["delegation_time"].day == 3
    assert (found["3"]["oauth_api_counter"], found["3"]["oauth_days_since_last_call"]) == (3, 1)
    assert (found["1"]["oauth_api_counter"], found["1"]["oauth_last_api_call"]) == (None, None)
    assert found["1"]["oauth_days_since_last_call"] is None and found["1"]["delegation_deleted"] is False


def test_revoked_delegations_on_request(activity):
    found = {r["oauth_client_id"]: r for r in inactive_delegations(activity, AS_OF, include_revoked=True).collect()}
    assert set(found) == {"1", "2", "3"} and found["2"]["delegation_time"].day == 2
