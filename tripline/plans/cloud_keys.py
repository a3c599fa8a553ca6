"""Detections around service-account keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.docs import decode_codes, doc_get
from tripline.functions.predicates import full_match
from tripline.functions.text import last_part
from tripline.functions.timeops import HOUR, days_between, from_epoch_seconds, recent, time_slice
from tripline.operators.aggs import sorted_set
from tripline.operators.latest import first_seen_flag
from tripline.operators.lookups import flag_known, suffix_pattern_join
from tripline.operators.workdir import WorkDir

# Fixed values of the cloud audit log.
KEY_METHOD = "CreateServiceAccountKey"
KEY_SERVICE = "iam.googleapis.com"
KEY_FORMATS = ("UNSPECIFIED", "PKCS12_FILE", "GOOGLE_CREDENTIALS_FILE")
KEY_MANAGEMENT = ("KEY_TYPE_UNSPECIFIED", "USER_MANAGED", "SYSTEM_MANAGED")
KEY_ORIGINS = ("ORIGIN_UNSPECIFIED", "USER_PROVIDED", "GOOGLE_PROVIDED")
FIRST_KEY = "first_key_for_sa"
LATER_KEY = "new_key_for_existing_sa"
# Fixed values of the collaboration suite's admin log.
ADMIN = "admin"
GRANT_EVENT = "AUTHORIZE_API_CLIENT_ACCESS"
REVOKE_EVENT = "REMOVE_API_CLIENT_ACCESS"
SETTINGS_EVENT_TYPE = "DOMAIN_SETTINGS"
SERVICE_ACCOUNT = "SA_TYPE"
MARKETPLACE_APP = "GWS_MARKETPLACE_APP"
# Which addresses count as known, and how key files are named.
KNOWN_SOURCE_TYPE = "endpoint_ip_mapping"
KEY_FILE_SUFFIX = r"-[a-z0-9]{12}\.json"
KEY_FILE_SUFFIX_LENGTH = 18


def client_kind(name: Column) -> Column:
    """A client named by digits only is a service account, any other a marketplace app."""
    return F.when(full_match(name, "[0-9]+"), F.lit(SERVICE_ACCOUNT)).otherwise(F.lit(MARKETPLACE_APP))


def key_creation_burst(
    gcp_audit: DataFrame, as_of: datetime | str, days: int = 60, min_events: int = 2, min_accounts: int = 1
) -> DataFrame:
    """Callers that create keys in quick succession, or for several accounts, within an hour."""
    code = {
        "sa_private_key_type": ("request.private_key_type", KEY_FORMATS),
        "sa_key_management_config": ("response.key_type", KEY_MANAGEMENT),
        "sa_key_origin": ("response.key_origin", KEY_ORIGINS),
    }
    created = (
        recent(gcp_audit, "event_time", days, as_of)
        .withColumn("strip_method_name", last_part("method_name", "."))
        .where(F.col("strip_method_name") == KEY_METHOD)
        .select(
            "event_time",
            "strip_method_name",
            time_slice("event_time", HOUR).alias("tumble_hour"),
            F.col("project_id").alias("gcp_project_id"),
            F.col("principal_email").alias("gcp_caller_email"),
            F.col("caller_ip").alias("sa_creation_caller_ip"),
            F.col("caller_user_agent").alias("sa_creation_user_agent"),
            from_epoch_seconds(doc_get("proto_payload", "response.valid_before_time.seconds", "bigint")).alias(
                "sa_expiration_date"
            ),
            doc_get("resource", "labels.unique_id").alias("client_id"),
            *[
                decode_codes(doc_get("proto_payload", path, "int"), labels).alias(name)
                for name, (path, labels) in code.items()
            ],
        )
    )
    keys = [
        "tumble_hour",
        "gcp_project_id",
        "gcp_caller_email",
        "sa_creation_caller_ip",
        "sa_creation_user_agent",
        "strip_method_name",
        "sa_expiration_date",
    ]
    # The set of clients is part of the result, so its size is the distinct count
    # and no second shuffle is needed. Groups that fail the threshold hold at
    # most one client: every large set is a result.
    return (
        created.groupBy(*keys)
        .agg(
            F.min("event_time").alias("earliest"),
            F.max("event_time").alias("latest"),
            F.count("*").alias("counter"),
            sorted_set("client_id").alias("service_account_oauth_client_ids"),
            *[sorted_set(name).alias(name) for name in code],
        )
        .withColumn("distinct_service_accounts", F.size("service_account_oauth_client_ids").cast("long"))
        .where((F.col("counter") > min_events) | (F.col("distinct_service_accounts") > min_accounts))
        .select(
            "earliest",
            "latest",
            "counter",
            "distinct_service_accounts",
            "tumble_hour",
            "gcp_project_id",
            "gcp_caller_email",
            "sa_creation_caller_ip",
            "sa_creation_user_agent",
            "service_account_oauth_client_ids",
            "strip_method_name",
            "sa_expiration_date",
            *code,
        )
    )


def delegation_with_key_origin(
    gsuite: DataFrame, gcp_audit: DataFrame, org_ip: DataFrame, as_of: datetime | str, work: WorkDir, days: int = 90
) -> DataFrame:
    """Delegation grants to service accounts with every key made for the same client.

    Keys made after the grant are included and give a negative day difference.
    "First key" means first within the look-back. Made keys are few and read
    twice, so they are stored in ``work`` when the job is called.
    """
    created = (
        recent(gcp_audit, "event_time", days, as_of)
        .where((F.col("service_name") == KEY_SERVICE) & (last_part("method_name", ".") == KEY_METHOD))
        .select(
            F.col("event_time").alias("key_creation_time"),
            F.col("project_id").alias("gcp_project_id"),
            F.col("principal_email").alias("gcp_caller_email"),
            F.col("caller_ip").alias("sa_creation_caller_ip"),
            F.col("caller_user_agent").alias("sa_creation_user_agent"),
            doc_get("resource", "labels.unique_id").alias("oauth_client_id"),
        )
        # A key without a client can join no grant.
        .where(F.col("oauth_client_id").isNotNull())
    )
    known_ips = org_ip.where(F.col("specific_source_type") == KNOWN_SOURCE_TYPE)
    flagged = flag_known(created, "sa_creation_caller_ip", known_ips, "ip", "known_organization_ip")
    ties = ["gcp_project_id", "gcp_caller_email", "sa_creation_caller_ip", "sa_creation_user_agent"]
    flagged = work.store(flagged, "keys")
    keyed = first_seen_flag(flagged, ["oauth_client_id"], "key_creation_time", ties, "is_first").withColumn(
        "sa_key_state", F.when(F.col("is_first"), F.lit(FIRST_KEY)).otherwise(F.lit(LATER_KEY))
    )
    grants = (
        recent(gsuite, "id_time", days, as_of)
        .where(
            (F.col("id_application_name") == ADMIN)
            & (F.col("event_name") == GRANT_EVENT)
            & (F.col("event_type") == SETTINGS_EVENT_TYPE)
        )
        .select(
            F.col("id_time").alias("delegation_time"),
            "actor_email",
            "event_name",
            doc_get("event_parameters", "API_CLIENT_NAME").alias("identity_object_gsw"),
            doc_get("event_parameters", "API_SCOPES").alias("api_scopes"),
            doc_get("event_parameters", "DOMAIN_NAME").alias("domain_name"),
        )
        .withColumn("api_type", client_kind(F.col("identity_object_gsw")))
        .where(F.col("api_type") == SERVICE_ACCOUNT)
    )
    return grants.join(keyed, F.col("identity_object_gsw") == F.col("oauth_client_id"), "left").select(
        "delegation_time",
        "actor_email",
        "event_name",
        "identity_object_gsw",
        "api_type",
        "api_scopes",
        "domain_name",
        "key_creation_time",
        "gcp_caller_email",
        "sa_creation_caller_ip",
        "known_organization_ip",
        "sa_creation_user_agent",
        "sa_key_state",
        "gcp_project_id",
        days_between("key_creation_time", "delegation_time").alias("day_diff_btw_dt_kc"),
    )


def plaintext_key_files(
    edr_file: DataFrame, gcp_audit: DataFrame, as_of: datetime | str, days: int = 20
) -> DataFrame:
    """Files named like a downloaded key of a project that is active in the audit log."""
    projects = recent(gcp_audit, "event_time", days, as_of)
    files = recent(edr_file, "event_time", days, as_of).where(F.col("target_file_extension") == "json")
    return suffix_pattern_join(
        files, "target_file_name", projects, "project_id", KEY_FILE_SUFFIX, KEY_FILE_SUFFIX_LENGTH
    ).select(
        "event_time",
        "agent_id",
        "device_platform",
        "parent_process_name",
        "initiating_process_name",
        "initiating_process_commandline",
        "target_file_name",
        "target_file_path",
        "target_file_extension",
        "target_file_hash_sha256",
        "target_file_action",
    )
