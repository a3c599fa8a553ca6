"""Detections over delegated access in the collaboration suite."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.docs import doc_get
from tripline.functions.timeops import as_ntz, days_between, recent, within
from tripline.operators.aggs import sorted_set
from tripline.operators.latest import latest_per_key
from tripline.operators.lookups import novel_vs_baseline
from tripline.operators.workdir import WorkDir
from tripline.plans.cloud_keys import (
    ADMIN,
    GRANT_EVENT,
    REVOKE_EVENT,
    SERVICE_ACCOUNT,
    SETTINGS_EVENT_TYPE,
    client_kind,
)

# Fixed values of the collaboration suite's token log, and the default learning range.
TOKEN = "token"
TOKEN_EVENT = "activity"
LEARN_FROM = "2023-07-01 00:00:00"
LEARN_TO = "2023-09-01 00:00:00"


def novel_api_calls(
    gsuite: DataFrame,
    learn_from: datetime | str = LEARN_FROM,
    learn_to: datetime | str = LEARN_TO,
    as_of: datetime | str | None = None,
    days: int | None = None,
    work: WorkDir | None = None,
) -> DataFrame:
    """Service-account calls whose actor, address and method were not seen while learning.

    With ``as_of`` and ``days`` only calls of that look-back are reported, which
    bounds the addresses a row can list. With ``work`` what was learned is stored
    there, so the log of the learning range is read once.
    """
    calls = gsuite.where(
        (F.col("id_application_name") == TOKEN) & (F.col("event_name") == TOKEN_EVENT)
    ).withColumn("method_name", doc_get("event_parameters", "method_name"))
    baseline = within(calls, "id_time", learn_from, learn_to)
    keys = ["actor_email", "client_id", "method_name", "api_type"]
    # The novelty test only reads group keys of this first step, so it can run on
    # the aggregate: a busy caller reaches the join as a few rows.
    reported = calls if as_of is None or days is None else recent(calls, "id_time", days, as_of)
    per_address = (
        reported.withColumn("client_id", doc_get("event_parameters", "client_id"))
        .withColumn("api_type", client_kind(doc_get("event_parameters", "app_name")))
        .where(F.col("api_type") == SERVICE_ACCOUNT)
        .groupBy(*keys, "ip_address")
        .agg(F.min("id_time").alias("earliest"), F.max("id_time").alias("latest"))
    )
    novel = novel_vs_baseline(per_address, baseline, ["actor_email", "method_name"], "ip_address", work)
    return (
        novel.groupBy(*keys)
        .agg(
            F.min("earliest").alias("earliest"),
            F.max("latest").alias("latest"),
            sorted_set("ip_address").alias("source_ips"),
        )
        .select("earliest", "latest", "client_id", "method_name", "api_type", "source_ips", "actor_email")
    )


def inactive_delegations(
    gsuite: DataFrame, as_of: datetime | str, days: int = 300, include_revoked: bool = False
) -> DataFrame:
    """The latest delegation of each service account with its number of calls and last call.

    A client whose latest event is a revocation is left out. With
    ``include_revoked`` revocations are ignored and its latest grant is shown.
    """
    events = recent(gsuite, "id_time", days, as_of)
    delegations = (
        events.where(
            (F.col("id_application_name") == ADMIN)
            & F.col("event_name").isin(GRANT_EVENT, REVOKE_EVENT)
            & (F.col("event_type") == SETTINGS_EVENT_TYPE)
        )
        .select(
            F.col("id_time").alias("delegation_time"),
            doc_get("event_parameters", "API_CLIENT_NAME").alias("oauth_client_id"),
            "actor_email",
            doc_get("event_parameters", "DOMAIN_NAME").alias("domain_name"),
            doc_get("event_parameters", "API_SCOPES").alias("oauth_scopes"),
            (F.col("event_name") == REVOKE_EVENT).alias("delegation_deleted"),
        )
        .where(client_kind(F.col("oauth_client_id")) == SERVICE_ACCOUNT)
    )
    active = ~F.col("delegation_deleted")
    ties = ["delegation_deleted", "actor_email", "domain_name", "oauth_scopes"]
    if include_revoked:
        delegations = delegations.where(active)
    latest = latest_per_key(delegations, ["oauth_client_id"], "delegation_time", ties).where(active)
    # Counting every client first is cheap, as each map task emits one row per
    # client. Looking up delegated clients before counting would shuffle the log.
    calls = (
        events.withColumn("_client", doc_get("event_parameters", "client_id"))
        .where(F.col("_client").isNotNull())
        .groupBy("_client")
        .agg(F.count("*").alias("oauth_api_counter"), F.max("id_time").alias("oauth_last_api_call"))
    )
    return latest.join(calls, F.col("oauth_client_id") == F.col("_client"), "left").select(
        "delegation_time",
        "oauth_client_id",
        "actor_email",
        "domain_name",
        "oauth_scopes",
        "delegation_deleted",
        "oauth_api_counter",
        "oauth_last_api_call",
        days_between("oauth_last_api_call", as_ntz(as_of)).alias("oauth_days_since_last_call"),
    )
