"""Each detection on the derived log tables, with its oracle.

Arrays are returned as joined text so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import oracle_views, spark_view
from tripline import plans
from tripline.functions.timeops import DayFolders
from tripline.operators.steps import time_steps
from tripline.operators.workdir import WorkDir
from tripline.sources import load_source
from tripline.sources.file_times import FileTimes

# The tables' times lie in January 2024; each job looks back from a day that puts its bound into that month.
AS_OF = "2024-02-08 00:00:00"
AS_OF_20_DAYS = "2024-01-31 00:00:00"
AS_OF_60_DAYS = "2024-03-10 00:00:00"
AS_OF_90_DAYS = "2024-04-09 00:00:00"
AS_OF_300_DAYS = "2024-11-05 00:00:00"
OWN_ACCOUNTS = ("111111111111", "222222222222")
LEARN = ("2024-01-01 00:00:00", "2024-01-12 00:00:00")


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Replace arrays of text by their elements joined with commas."""
    return df.withColumns({name: F.array_join(name, ",") for name in names})


def joined_sets(df: DataFrame, *names: str) -> DataFrame:
    """Replace arrays of arrays by text: '+' inside, ',' between, sorted."""

    def flat(name: str) -> Column:
        return F.array_join(F.array_sort(F.transform(name, lambda inner: F.array_join(inner, "+"))), ",")

    return df.withColumns({name: flat(name) for name in names})


def key_creation_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = plans.key_creation_burst(spark_view(spark, sf_dir, "gcp_audit"), AS_OF_60_DAYS)
    return joined(
        result,
        "service_account_oauth_client_ids",
        "sa_private_key_type",
        "sa_key_management_config",
        "sa_key_origin",
    )


KEY_CREATION_BURST = (
    oracle_views("gcp_audit")
    + """,
picked AS (
  SELECT event_time, date_trunc('hour', event_time) AS tumble_hour, project_id, principal_email, caller_ip,
         caller_user_agent, regexp_extract(method_name, '[^.]*$') AS strip_method_name,
         json_extract_string(resource, '$.labels.unique_id') AS client,
         CAST(json_extract_string(proto_payload, '$.request.private_key_type') AS INT) AS format_code,
         CAST(json_extract_string(proto_payload, '$.response.key_type') AS INT) AS type_code,
         CAST(json_extract_string(proto_payload, '$.response.key_origin') AS INT) AS origin_code,
         CAST(json_extract_string(proto_payload, '$.response.valid_before_time.seconds') AS BIGINT) AS expiry
  FROM gcp_audit
  WHERE event_time > TIMESTAMP '2024-03-10' - INTERVAL 60 DAY
)
SELECT min(event_time) AS earliest, max(event_time) AS latest, count(*) AS counter,
       count(DISTINCT client) AS distinct_service_accounts, tumble_hour,
       project_id AS gcp_project_id, principal_email AS gcp_caller_email, caller_ip AS sa_creation_caller_ip,
       caller_user_agent AS sa_creation_user_agent,
       coalesce(string_agg(DISTINCT client, ',' ORDER BY client), '') AS service_account_oauth_client_ids,
       strip_method_name,
       TIMESTAMP '1970-01-01' + to_seconds(expiry) AS sa_expiration_date,
       coalesce(array_to_string(list_sort(
           list(DISTINCT ['UNSPECIFIED', 'PKCS12_FILE', 'GOOGLE_CREDENTIALS_FILE'][format_code + 1])
           FILTER (WHERE format_code < 3)), ','), '') AS sa_private_key_type,
       array_to_string(list_sort(
           list(DISTINCT ['KEY_TYPE_UNSPECIFIED', 'USER_MANAGED', 'SYSTEM_MANAGED'][type_code + 1])), ',')
           AS sa_key_management_config,
       array_to_string(list_sort(
           list(DISTINCT ['ORIGIN_UNSPECIFIED', 'USER_PROVIDED', 'GOOGLE_PROVIDED'][origin_code + 1])), ',')
           AS sa_key_origin
FROM picked
WHERE strip_method_name = 'CreateServiceAccountKey'
GROUP BY tumble_hour, project_id, principal_email, caller_ip, caller_user_agent, strip_method_name, expiry
HAVING count(*) > 2 OR count(DISTINCT client) > 1
"""
)

def delegation_with_key_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.delegation_with_key_origin(
        spark_view(spark, sf_dir, "gsuite_activity"),
        spark_view(spark, sf_dir, "gcp_audit"),
        spark_view(spark, sf_dir, "org_ip"),
        AS_OF_90_DAYS,
        WorkDir.for_session(spark),
    )


DELEGATION_WITH_KEY_ORIGIN = (
    oracle_views("gsuite_activity", "gcp_audit", "org_ip")
    + """,
made AS (
  SELECT event_time AS made_at, project_id, principal_email, caller_ip, caller_user_agent,
         json_extract_string(resource, '$.labels.unique_id') AS client
  FROM gcp_audit
  WHERE service_name = 'iam.googleapis.com' AND ends_with(method_name, '.CreateServiceAccountKey')
    AND event_time > TIMESTAMP '2024-04-09' - INTERVAL 90 DAY
),
ranked AS (
  SELECT made.*, row_number() OVER (PARTITION BY client ORDER BY made_at, project_id) AS position,
         EXISTS (SELECT 1 FROM org_ip WHERE ip = caller_ip AND specific_source_type = 'endpoint_ip_mapping') AS known
  FROM made WHERE client IS NOT NULL
),
granted AS (
  SELECT id_time, actor_email, event_name, event_parameters ->> 'API_CLIENT_NAME' AS client,
         event_parameters ->> 'API_SCOPES' AS api_scopes, event_parameters ->> 'DOMAIN_NAME' AS domain_name
  FROM gsuite_activity
  WHERE id_application_name = 'admin' AND event_name = 'AUTHORIZE_API_CLIENT_ACCESS'
    AND event_type = 'DOMAIN_SETTINGS' AND id_time > TIMESTAMP '2024-04-09' - INTERVAL 90 DAY
)
SELECT id_time AS delegation_time, actor_email, event_name, granted.client AS identity_object_gsw,
       'SA_TYPE' AS api_type, api_scopes, domain_name, made_at AS key_creation_time,
       principal_email AS gcp_caller_email, caller_ip AS sa_creation_caller_ip, known AS known_organization_ip,
       caller_user_agent AS sa_creation_user_agent,
       CASE WHEN position = 1 THEN 'first_key_for_sa' WHEN position > 1 THEN 'new_key_for_existing_sa' END AS sa_key_state,
       project_id AS gcp_project_id,
       CAST(CAST(id_time AS DATE) - CAST(made_at AS DATE) AS INT) AS day_diff_btw_dt_kc
FROM granted LEFT JOIN ranked ON ranked.client = granted.client
WHERE regexp_full_match(granted.client, '[0-9]+')
"""
)


def novel_api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(plans.novel_api_calls(spark_view(spark, sf_dir, "gsuite_activity"), *LEARN), "source_ips")


NOVEL_API_CALLS = (
    oracle_views("gsuite_activity")
    + """,
calls AS (
  SELECT id_time, actor_email, ip_address, event_parameters ->> 'client_id' AS client_id,
         event_parameters ->> 'method_name' AS method_name, event_parameters ->> 'app_name' AS app_name
  FROM gsuite_activity WHERE id_application_name = 'token' AND event_name = 'activity'
)
SELECT min(id_time) AS earliest, max(id_time) AS latest, client_id, method_name, 'SA_TYPE' AS api_type,
       coalesce(string_agg(DISTINCT ip_address, ',' ORDER BY ip_address), '') AS source_ips, actor_email
FROM calls
WHERE regexp_full_match(app_name, '[0-9]+')
  AND NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT actor_email AS a, ip_address AS i, method_name AS m FROM calls
                       WHERE id_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-12'
                         AND ip_address IS NOT NULL) AS learnt
        WHERE coalesce(a = actor_email, TRUE) AND coalesce(i = ip_address, TRUE) AND coalesce(m = method_name, TRUE))
GROUP BY client_id, method_name, actor_email
"""
)


def plaintext_key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.plaintext_key_files(
        spark_view(spark, sf_dir, "edr_file"), spark_view(spark, sf_dir, "gcp_audit"), AS_OF_20_DAYS
    )


PLAINTEXT_KEY_FILES = (
    oracle_views("edr_file", "gcp_audit")
    + """,
projects AS (
  SELECT DISTINCT project_id FROM gcp_audit
  WHERE project_id IS NOT NULL AND event_time > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
)
SELECT event_time, agent_id, device_platform, parent_process_name, initiating_process_name,
       initiating_process_commandline, target_file_name, target_file_path, target_file_extension,
       target_file_hash_sha256, target_file_action
FROM edr_file JOIN projects ON regexp_full_match(target_file_name, project_id || '-[a-z0-9]{12}[.]json')
WHERE target_file_extension = 'json' AND event_time > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
"""
)


def inactive_delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.inactive_delegations(spark_view(spark, sf_dir, "gsuite_activity"), AS_OF_300_DAYS)


INACTIVE_DELEGATIONS = (
    oracle_views("gsuite_activity")
    + """,
admin AS (
  SELECT id_time, actor_email, event_name, event_parameters ->> 'API_CLIENT_NAME' AS client,
         event_parameters ->> 'DOMAIN_NAME' AS domain_name, event_parameters ->> 'API_SCOPES' AS scopes
  FROM gsuite_activity
  WHERE id_application_name = 'admin' AND event_type = 'DOMAIN_SETTINGS'
    AND event_name IN ('AUTHORIZE_API_CLIENT_ACCESS', 'REMOVE_API_CLIENT_ACCESS')
    AND id_time > TIMESTAMP '2024-11-05' - INTERVAL 300 DAY
),
last_one AS (
  SELECT * FROM admin WHERE regexp_full_match(client, '[0-9]+')
  QUALIFY row_number() OVER (PARTITION BY client ORDER BY id_time DESC, event_name DESC) = 1
),
used AS (
  SELECT event_parameters ->> 'client_id' AS client, count(*) AS calls, max(id_time) AS last_call
  FROM gsuite_activity
  WHERE id_time > TIMESTAMP '2024-11-05' - INTERVAL 300 DAY GROUP BY ALL
)
SELECT id_time AS delegation_time, last_one.client AS oauth_client_id, actor_email, domain_name,
       scopes AS oauth_scopes, FALSE AS delegation_deleted, calls AS oauth_api_counter,
       last_call AS oauth_last_api_call,
       CAST(DATE '2024-11-05' - CAST(last_call AS DATE) AS INT) AS oauth_days_since_last_call
FROM last_one LEFT JOIN used ON used.client = last_one.client
WHERE event_name = 'AUTHORIZE_API_CLIENT_ACCESS'
"""
)


def inactive_delegations_with_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = spark_view(spark, sf_dir, "gsuite_activity")
    return plans.inactive_delegations(activity, AS_OF_300_DAYS, include_revoked=True)


# Revocations are filtered out before the latest event is picked.
INACTIVE_DELEGATIONS_WITH_REVOKED = INACTIVE_DELEGATIONS.replace(
    "event_name IN ('AUTHORIZE_API_CLIENT_ACCESS', 'REMOVE_API_CLIENT_ACCESS')",
    "event_name = 'AUTHORIZE_API_CLIENT_ACCESS'",
)


def stored_log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key bursts over an audit log that is stored in day folders with its documents as JSON text."""
    log = spark_view(spark, sf_dir, "gcp_audit")
    text = log.withColumns({name: F.to_json(name) for name in ("resource", "proto_payload")})
    path = WorkDir.for_session(spark).new_path("audit")
    text.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(path)
    since = F.lit(AS_OF_60_DAYS).cast("timestamp_ntz") - F.expr("INTERVAL 60 DAY")
    first = spark.range(1).select(since.cast("string")).first()[0]
    stored = load_source(spark, "gcp_audit", path, folders=DayFolders("event_date", margin_days=1), since=first)
    return joined(
        plans.key_creation_burst(stored, AS_OF_60_DAYS),
        "service_account_oauth_client_ids",
        "sa_private_key_type",
        "sa_key_management_config",
        "sa_key_origin",
    )


def webdav_script_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.webdav_script_execution(spark_view(spark, sf_dir, "edr_process"), AS_OF)


WEBDAV_SCRIPT_EXECUTION = (
    oracle_views("edr_process")
    + """
SELECT DISTINCT event_time, agent_id, target_process_commandline FROM edr_process
WHERE regexp_matches(lower(target_process_commandline), '(?s)wscript[.]exe.*[\\\\].*@.*[\\\\].*[.]jse')
  AND event_time > TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
ORDER BY event_time
"""
)


def webdav_retrieval_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.webdav_retrieval_hosts(spark_view(spark, sf_dir, "edr_process"), AS_OF)


WEBDAV_RETRIEVAL_HOSTS = (
    oracle_views("edr_process")
    + """,
fetched AS (
  SELECT agent_id, target_process_commandline AS cmd,
         regexp_extract(lower(target_process_commandline), '//([^/]*)', 1) AS host
  FROM edr_process
  WHERE lower(target_process_commandline) LIKE '%rundll32.exe %\\windows\\system32\\davclnt.dll,%davsetcookie %'
    AND event_time > TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
    AND device_platform = 'WINDOWS' AND coalesce(initiating_process_name, 'svchost.exe') = 'svchost.exe'
),
octets AS (
  SELECT *, TRY_CAST(split_part(host, '.', 1) AS INT) AS o1, TRY_CAST(split_part(host, '.', 2) AS INT) AS o2
  FROM fetched WHERE contains(host, '.')
)
SELECT host AS target_server, count(DISTINCT agent_id) AS distinct_aids,
       count(DISTINCT lower(cmd)) AS distinct_cmdlines, min(cmd) AS example_target_process_commandline
FROM octets
WHERE NOT (coalesce(o1 IN (10, 127, 0) OR o1 BETWEEN 224 AND 255, FALSE)
           OR coalesce(o1 = 172 AND o2 BETWEEN 16 AND 31, FALSE)
           OR coalesce(o1 = 100 AND o2 BETWEEN 64 AND 127, FALSE)
           OR coalesce(o1 = 198 AND o2 BETWEEN 18 AND 19, FALSE)
           OR starts_with(host, '192.168.') OR starts_with(host, '169.254.')
           OR starts_with(host, '192.0.0.') OR starts_with(host, '192.0.2.')
           OR starts_with(host, '192.88.99.') OR starts_with(host, '198.51.100.')
           OR starts_with(host, '203.0.113.')
           OR starts_with(host, 'fc00') OR starts_with(host, 'fe80') OR starts_with(host, 'ff00')
           OR starts_with(host, 'localhost:') OR host = 'localhost')
GROUP BY host ORDER BY host
"""
)


def elevated_com_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.elevated_com_children(spark_view(spark, sf_dir, "edr_raw"), AS_OF, WorkDir.for_session(spark))


def _stored(
    spark: SparkSession, sf_dir: str, view: str, source: str, work: WorkDir, since: str, documents: tuple[str, ...] = ()
) -> DataFrame:
    """A log as it is stored: files in order of time, documents as JSON text, the files' times kept beside it."""
    log = spark_view(spark, sf_dir, view)
    text = log.withColumns({name: F.to_json(name) for name in documents})
    stored = work.growing(view)
    for step in time_steps(log, "event_time"):
        stored.add(text.where(step).repartitionByRange(16, "event_time"), ["event_time"])
    times = FileTimes(spark, work.new_path("times"))
    times.rebuild(stored.path)
    return load_source(spark, source, stored.path, file_times=times, since=since)


def stored_com_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stored log of which only files with events of the look-back are opened."""
    work = WorkDir.for_session(spark)
    return plans.elevated_com_children(_stored(spark, sf_dir, "edr_raw", "edr_raw", work, "2024-01-09 00:00:00"), AS_OF, work)


ELEVATED_COM_CHILDREN = (
    oracle_views("edr_raw")
    + """,
started AS (
  SELECT * FROM edr_raw
  WHERE starts_with(event_name, 'Process') AND event_time > TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
),
com AS (
  SELECT * FROM started
  WHERE ends_with(lower(command_line),
                  '\\windows\\system32\\dllhost.exe /processid:{3e5fc7f9-9a51-4367-9063-a120244fbec7}')
)
SELECT DISTINCT child.event_time AS elevated_process_creation_time, child.aid AS agent_id, child.event_name,
       child.command_line AS elevated_process_command_line, child.target_process_hash AS elevated_process_hash,
       child.integrity_level_description AS target_elevated_proc_integrity_level,
       client.image_file_name AS uac_bypass_initiating_process_name,
       client.command_line AS uac_bypass_initiating_command_line,
       client.target_process_hash AS initiating_process_hash
FROM com
JOIN started AS child
  ON child.aid = com.aid AND child.parent_process_id = com.target_process_id
 AND child.integrity_level_description = 'high_integrity'
 AND child.event_time - com.event_time BETWEEN INTERVAL 0 MINUTE AND INTERVAL 10 MINUTE
LEFT JOIN started AS client
  ON client.aid = com.aid AND client.target_process_id = com.rpc_client_process_id
 AND com.event_time - client.event_time BETWEEN INTERVAL 0 MINUTE AND INTERVAL 10 MINUTE
ORDER BY 1
"""
)


def consent_prompt_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.consent_prompt_disabled(
        spark_view(spark, sf_dir, "edr_raw"),
        spark_view(spark, sf_dir, "edr_process"),
        AS_OF,
        WorkDir.for_session(spark),
    )


CONSENT_PROMPT_DISABLED = (
    oracle_views("edr_raw", "edr_process")
    + """,
writes AS (
  SELECT DISTINCT event_time, aid, event_name, registry_key, registry_value_name, registry_str_value_data,
         registry_int_value_data, registry_operation_type, initiating_process_id
  FROM edr_raw
  WHERE event_time > TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
    AND regexp_matches(lower(event_name), 'reg.*update')
    AND ends_with(lower(registry_key), '\\software\\microsoft\\windows\\currentversion\\policies\\system')
    AND registry_value_name = 'ConsentPromptBehaviorAdmin'
    AND registry_operation_type = '1' AND registry_int_value_data = 0
)
SELECT writes.*, p.target_process_commandline AS initiating_process_command_line,
       p.target_process_hash AS initiating_process_hash
FROM writes LEFT JOIN edr_process AS p
  ON p.agent_id = writes.aid AND p.target_process_uid = writes.initiating_process_id
 AND p.event_time > TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
ORDER BY event_time
"""
)

_HTA_WHERE = """
WHERE device_platform = 'WINDOWS' AND event_time >= TIMESTAMP '2024-02-08' - INTERVAL 30 DAY
  AND (lower({process}) = 'mshta.exe' OR regexp_matches(lower({cmd}), 'rundll.*mshtml'))
  AND regexp_matches(lower({cmd}), 'http|activexobject|wscript|users[\\\\]public')
"""


def _hta(view: str, columns: str, side: str, distinct: str) -> str:
    where = _HTA_WHERE.format(process=f"{side}_process_name", cmd=f"{side}_process_commandline")
    return f"{oracle_views(view)}\nSELECT {distinct} {columns} FROM {view} {where}"


def hta_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hta_target(spark_view(spark, sf_dir, "edr_process"), AS_OF)


_START_COLUMNS = "event_time, initiating_process_name, target_process_commandline, target_process_uid"
HTA_TARGET = _hta("edr_process", _START_COLUMNS, "target", "DISTINCT")


def hta_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hta_children(spark_view(spark, sf_dir, "edr_process"), AS_OF)


HTA_CHILDREN = _hta("edr_process", _START_COLUMNS, "initiating", "DISTINCT")


def hta_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hta_network(spark_view(spark, sf_dir, "edr_network"), AS_OF)


HTA_NETWORK = _hta(
    "edr_network",
    "event_time, initiating_process_commandline, remote_ip, remote_port, domain, is_inbound",
    "initiating",
    "",
)


def hta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hta_files(spark_view(spark, sf_dir, "edr_file"), AS_OF)


HTA_FILES = _hta(
    "edr_file",
    "event_time, initiating_process_commandline, target_file_action, target_file_path",
    "initiating",
    "",
)

# Text of a set of actions, and which kinds of action it holds.
_SLICES = """
slices AS (
  SELECT time_bucket(INTERVAL 5 SECOND, event_time) AS slice, user_id, raw ->> 'UserAgent' AS agent,
         raw ->> 'SourceRelativeUrl' AS folder, object_id,
         string_agg(DISTINCT operation, '+' ORDER BY operation) AS actions,
         string_agg(DISTINCT client_ip, ',' ORDER BY client_ip) AS ips,
         count(DISTINCT record_specific_details ->> 'file_sync_bytes_committed') AS sizes,
         bool_or(operation IN ('FileDownloaded', 'FileCopied', 'FileSyncDownloadedFull')) AS retrieved,
         bool_or(operation IN ('FileModified', 'FileModifiedExtended', 'FileSyncUploadedFull', 'FileDeleted',
                               'FileRecycled', 'FileDeletedFirstStageRecycleBin',
                               'FileDeletedSecondStageRecycleBin')) AS destroyed
  FROM {view} WHERE workload = 'OneDrive' GROUP BY ALL
)
"""


def immediate_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = plans.immediate_encrypt(spark_view(spark, sf_dir, "o365_immediate"))
    return joined_sets(joined(result, "source_ips", "involved_files", "involved_folders"), "all_action_seen")


IMMEDIATE_ENCRYPT = (
    oracle_views("o365_immediate")
    + ","
    + _SLICES.format(view="o365_immediate")
    + """
SELECT date_trunc('minute', slice) AS group_start_time, date_trunc('minute', slice) + INTERVAL 1 MINUTE AS group_end_time,
       user_id, agent AS user_agent, ips AS source_ips,
       string_agg(DISTINCT object_id, ',' ORDER BY object_id) AS involved_files,
       string_agg(DISTINCT folder, ',' ORDER BY folder) AS involved_folders,
       string_agg(DISTINCT actions, ',' ORDER BY actions) AS all_action_seen,
       count(*) AS all_actions_count
FROM slices WHERE retrieved AND destroyed AND sizes <> 1
GROUP BY ALL HAVING count(DISTINCT object_id) >= 10
"""
)


def _staged_text(result: DataFrame) -> DataFrame:
    return joined_sets(
        joined(result, "involved_files", "matched_files"), "collection_seen_actions", "encryption_seen_actions"
    )


def staged_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged_text(plans.staged_encrypt(spark_view(spark, sf_dir, "o365_staged"), WorkDir.for_session(spark)))


def stored_staged_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stored log; its events without a time, which stages of their own could hold, are read as well."""
    work = WorkDir.for_session(spark)
    log = _stored(spark, sf_dir, "o365_staged", "o365_audit", work, "2024-01-01 00:00:00", ("raw", "record_specific_details"))
    return _staged_text(plans.staged_encrypt(log, work))


STAGED_ENCRYPT = (
    oracle_views("o365_staged")
    + ","
    + _SLICES.format(view="o365_staged")
    + """,
stages AS (
  SELECT kind, time_bucket(INTERVAL 5 MINUTE, slice) AS start, user_id, agent, ips,
         list_sort(list(DISTINCT object_id)) AS files, string_agg(DISTINCT actions, ',' ORDER BY actions) AS seen
  FROM (SELECT *, 'collection' AS kind FROM slices WHERE retrieved
        UNION ALL SELECT *, 'encryption' AS kind FROM slices WHERE destroyed)
  GROUP BY ALL HAVING count(DISTINCT object_id) >= 60 AND count(DISTINCT folder) > 1
)
SELECT c.user_id, c.start AS collection_start_time, c.start + INTERVAL 5 MINUTE AS collection_end_time,
       c.seen AS collection_seen_actions, e.start AS encryption_start_time,
       e.start + INTERVAL 5 MINUTE AS encryption_end_time, e.seen AS encryption_seen_actions,
       array_to_string(e.files, ',') AS involved_files,
       array_to_string(list_sort(list_intersect(c.files, e.files)), ',') AS matched_files
FROM stages AS c JOIN stages AS e ON c.user_id = e.user_id AND c.kind = 'collection' AND e.kind = 'encryption'
WHERE c.start BETWEEN e.start - INTERVAL 7 DAY AND e.start
  AND len(list_intersect(c.files, e.files)) >= 0.75 * least(len(c.files), len(e.files))
"""
)


def foreign_kms_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.foreign_kms_encryption(spark_view(spark, sf_dir, "cloudtrail"), OWN_ACCOUNTS)


FOREIGN_KMS_ENCRYPTION = (
    oracle_views("cloudtrail")
    + """
SELECT min(event_time) AS start_time, max(event_time) AS end_time, event_name, aws_region, source_ip_address,
       user_agent, user_identity_type, user_identity_arn, request_parameters ->> 'bucketName' AS bucket_name,
       count(*) FILTER (WHERE error_code IS NULL AND response_kms_key IS NOT NULL) AS successful_attempts,
       count(*) FILTER (WHERE error_code IS NOT NULL OR response_kms_key IS NULL) AS failed_attempts,
       count(DISTINCT object_key) AS object_count
FROM cloudtrail
WHERE event_name IN ('CopyObject', 'PutObject', 'CreateMultipartUpload')
  AND NOT ends_with(source_ip_address, '.amazonaws.com')
  AND NOT starts_with(request_kms_key_alias, 'alias/aws/')
  AND request_kms_key_aws_account NOT IN ('111111111111', '222222222222')
GROUP BY date_trunc('hour', event_time), event_name, aws_region, source_ip_address, user_agent,
         user_identity_type, user_identity_arn, request_parameters ->> 'bucketName'
"""
)

def short_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.short_lifecycle(spark_view(spark, sf_dir, "cloudtrail"))


SHORT_LIFECYCLE = (
    oracle_views("cloudtrail")
    + """,
rules AS (
  SELECT *, CAST(json_extract_string(request_parameters, '$.LifecycleConfiguration.Rule.Expiration.Days') AS INT) AS d,
         json_extract_string(request_parameters, '$.LifecycleConfiguration.Rule.Status') AS s
  FROM cloudtrail WHERE event_name = 'PutBucketLifecycle' AND event_source = 's3.amazonaws.com'
)
SELECT event_time, user_identity_arn, user_identity_user_name, user_identity_type,
       CASE user_identity_type WHEN 'AssumedRole' THEN regexp_extract(user_identity_arn, '^[^/]*/([^/]*)', 1) END
           AS user_role,
       user_identity_access_key_id, recipient_account_id, event_name, event_source, source_ip_address, user_agent,
       request_parameters ->> 'bucketName' AS bucket_name, d AS expiration_days, s AS status, error_code
FROM rules
WHERE d < 7 AND s = 'Enabled' AND NOT ends_with(source_ip_address, '.amazonaws.com')
"""
)


def short_lifecycle_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every rule of requests that hold several."""
    return plans.short_lifecycle(spark_view(spark, sf_dir, "cloudtrail"), rule_lists=True)


SHORT_LIFECYCLE_LISTS = SHORT_LIFECYCLE.replace(
    "rules AS (",
    """single AS (
  SELECT * REPLACE (json_object('LifecycleConfiguration', json_object('Rule', rule), 'bucketName', bucket) AS request_parameters)
  FROM (SELECT *, unnest(CASE json_type(request_parameters, '$.LifecycleConfiguration.Rule') WHEN 'ARRAY'
                         THEN CAST(json_extract(request_parameters, '$.LifecycleConfiguration.Rule') AS JSON[])
                         ELSE [json_extract(request_parameters, '$.LifecycleConfiguration.Rule')] END) AS rule,
               request_parameters ->> 'bucketName' AS bucket
        FROM cloudtrail)
),
rules AS (""",
).replace("FROM cloudtrail WHERE", "FROM single WHERE")


def object_deletion_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.object_deletion_burst(
        spark_view(spark, sf_dir, "cloudtrail"), spark_view(spark, sf_dir, "org_ip")
    )


OBJECT_DELETION_BURST = (
    oracle_views("cloudtrail", "org_ip")
    + """,
deleted AS (
  SELECT *, date_trunc('hour', event_time) AS hour, request_parameters ->> 'bucketName' AS bucket_name,
         CASE user_identity_type WHEN 'AssumedRole' THEN regexp_extract(user_identity_arn, '^[^/]*/([^/]*)', 1) END
             AS user_role
  FROM cloudtrail
  WHERE event_name IN ('DeleteObject', 'DeleteObjects') AND event_source = 's3.amazonaws.com'
    AND NOT ends_with(source_ip_address, '.amazonaws.com')
    AND NOT EXISTS (SELECT 1 FROM org_ip WHERE ip = source_ip_address)
)
SELECT min(event_time) AS start_time, max(event_time) AS end_time, user_identity_arn, user_identity_type, user_role,
       user_identity_access_key_id, recipient_account_id, event_name, event_source, source_ip_address, user_agent,
       bucket_name, count(*) FILTER (WHERE error_code IS NULL) AS successful_attempts,
       count(error_code) AS failed_attempts, count(DISTINCT object_key) AS object_count
FROM deleted
GROUP BY hour, user_identity_arn, user_identity_type, user_role, user_identity_access_key_id, recipient_account_id,
         event_name, event_source, source_ip_address, user_agent, bucket_name
HAVING count(DISTINCT object_key) > 20 OR event_name = 'DeleteObjects'
"""
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, tuple[Query, str]] = {
    "key_creation_burst": (key_creation_burst, KEY_CREATION_BURST),
    "delegation_with_key_origin": (delegation_with_key_origin, DELEGATION_WITH_KEY_ORIGIN),
    "novel_api_calls": (novel_api_calls, NOVEL_API_CALLS),
    "plaintext_key_files": (plaintext_key_files, PLAINTEXT_KEY_FILES),
    "inactive_delegations": (inactive_delegations, INACTIVE_DELEGATIONS),
    "inactive_delegations_with_revoked": (inactive_delegations_with_revoked, INACTIVE_DELEGATIONS_WITH_REVOKED),
    "stored_log_keys": (stored_log_keys, KEY_CREATION_BURST),
    "webdav_script_execution": (webdav_script_execution, WEBDAV_SCRIPT_EXECUTION),
    "webdav_retrieval_hosts": (webdav_retrieval_hosts, WEBDAV_RETRIEVAL_HOSTS),
    "elevated_com_children": (elevated_com_children, ELEVATED_COM_CHILDREN),
    "stored_com_children": (stored_com_children, ELEVATED_COM_CHILDREN),
    "consent_prompt_disabled": (consent_prompt_disabled, CONSENT_PROMPT_DISABLED),
    "hta_target": (hta_target, HTA_TARGET),
    "hta_children": (hta_children, HTA_CHILDREN),
    "hta_network": (hta_network, HTA_NETWORK),
    "hta_files": (hta_files, HTA_FILES),
    "immediate_encrypt": (immediate_encrypt, IMMEDIATE_ENCRYPT),
    "staged_encrypt": (staged_encrypt, STAGED_ENCRYPT),
    "stored_staged_encrypt": (stored_staged_encrypt, STAGED_ENCRYPT),
    "foreign_kms_encryption": (foreign_kms_encryption, FOREIGN_KMS_ENCRYPTION),
    "short_lifecycle": (short_lifecycle, SHORT_LIFECYCLE),
    "short_lifecycle_lists": (short_lifecycle_lists, SHORT_LIFECYCLE_LISTS),
    "object_deletion_burst": (object_deletion_burst, OBJECT_DELETION_BURST),
}
