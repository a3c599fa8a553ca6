"""Log tables derived from the driver's tables.

The driver has no telemetry, so every source of the jobs is mapped out of its
``events``, ``orders`` and ``supplier`` tables, one or more log rows per table row.
Times, users and kinds come from the tables; details vary with the row's id. The
mapping is one SQL text that Spark and the oracle both run; the tokens that
start with ``$`` are the few places where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tripline.sources import SCHEMAS, conform

BACKSLASH = "chr(92)"

GCP_AUDIT = """
SELECT ts AS event_time,
       CASE WHEN event_id % 17 <> 0 THEN concat('proj-', user_id % 2) END AS project_id,
       concat('caller', user_id % 2, '@corp.example') AS principal_email,
       concat('10.1.0.', user_id % 3 + 8) AS caller_ip,
       'cli/1.0' AS caller_user_agent,
       CASE WHEN event_type = 'view' THEN 'storage.googleapis.com' ELSE 'iam.googleapis.com' END AS service_name,
       CASE WHEN event_type IN ('click', 'view') THEN 'google.iam.admin.v1.CreateServiceAccountKey'
            ELSE 'google.iam.admin.v1.ListServiceAccountKeys' END AS method_name,
       CASE WHEN event_id % 11 = 0 THEN '{}'
            ELSE concat('{"labels": {"unique_id": "', 100000 + user_id, '"}}') END AS resource,
       concat('{"request": {"private_key_type": ', event_id % 4,
              '}, "response": {"key_type": ', event_id % 3,
              ', "key_origin": ', (event_id + user_id) % 3,
              ', "valid_before_time": {"seconds": ',
              CASE WHEN user_id % 4 < 2 THEN 253402300799 ELSE 1767225600 END,
              '}}}') AS proto_payload
FROM $events
"""

GSUITE_ACTIVITY = """
SELECT ts AS id_time,
       CASE event_type WHEN 'signup' THEN 'admin' WHEN 'error' THEN 'drive' ELSE 'token' END AS id_application_name,
       CASE WHEN event_id % 29 <> 0 THEN concat('actor', user_id, '@corp.example') END AS actor_email,
       CASE WHEN event_id % 13 <> 0 THEN concat('172.30.', user_id, '.', event_id % 4) END AS ip_address,
       CASE event_type
            WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'REMOVE_API_CLIENT_ACCESS'
                                    ELSE 'AUTHORIZE_API_CLIENT_ACCESS' END
            WHEN 'error' THEN 'view'
            ELSE 'activity' END AS event_name,
       CASE WHEN event_id % 19 = 0 THEN 'USER_SETTINGS' ELSE 'DOMAIN_SETTINGS' END AS event_type,
       CASE event_type
            WHEN 'signup' THEN concat('{"API_CLIENT_NAME": "', CASE WHEN event_id % 7 = 0 THEN 'app' ELSE '' END,
                                      100000 + user_id, '", "API_SCOPES": "scope', event_id % 3,
                                      '", "DOMAIN_NAME": "corp.example"}')
            ELSE concat('{"client_id": "', 100000 + user_id * 2,
                        CASE WHEN event_id % 31 = 0 THEN '", "other": "m' ELSE '", "method_name": "m' END, event_id % 3,
                        '", "app_name": "', CASE WHEN event_id % 5 = 0 THEN 'mail' ELSE '' END, 7000 + user_id, '"}')
            END AS event_parameters
FROM $events
"""

ORG_IP = """
SELECT CASE WHEN s_suppkey % 10 <> 9 THEN concat('10.1.0.', s_suppkey) END AS ip,
       CASE WHEN s_suppkey % 2 = 0 THEN 'endpoint_ip_mapping' ELSE 'vpn' END AS specific_source_type
FROM $supplier
"""

# Hosts of every kind: internal ranges with their neighbours, names, a name without a dot.
HOSTS = (
    "10.0.0.1 11.0.0.1 172.15.0.9 172.16.0.9 172.31.0.9 172.32.0.9 100.63.1.1 100.64.1.1 100.127.1.1 100.128.1.1"
    " 198.17.0.1 198.18.0.1 198.19.0.1 198.20.0.1 223.7.7.7 224.7.7.7 239.7.7.7 240.7.7.7 255.7.7.7 localhost"
    " LocalHost:8080.corp intranet fe80.local 192.168.3.4 CDN1.example.com CDN2.example.com files.example.net"
)
_HOSTED_EVENTS = f"""
SELECT event_id, ts, user_id, event_type,
       split_part('{HOSTS}', ' ', CAST(floor(event_id / 10) % {len(HOSTS.split())} + 1 AS INT)) AS host
FROM $events
"""

_INITIATOR = """
       CASE WHEN event_id % 9 = 0 THEN 'LINUX' ELSE 'WINDOWS' END AS device_platform,
       CASE event_id % 5 WHEN 0 THEN 'MSHTA.exe' WHEN 1 THEN 'svchost.exe' WHEN 3 THEN 'explorer.exe' END
           AS initiating_process_name,
       CASE event_id % 4
            WHEN 0 THEN concat('mshta.exe HTTP://', host, '/start.hta')
            WHEN 1 THEN concat('RUNDLL32.exe MsHtml,Run C:', $bs, 'Users', $bs, 'Public', $bs, 'a')
            WHEN 2 THEN 'mshta.exe local.hta'
            ELSE 'explorer.exe' END AS initiating_process_commandline,
"""

EDR_PROCESS = f"""
SELECT ts AS event_time,
       concat('agent', user_id) AS agent_id,
       {_INITIATOR}
       CASE event_id % 10 WHEN 0 THEN 'Mshta.exe' WHEN 5 THEN 'mshta.exe' ELSE 'other.exe' END AS target_process_name,
       CASE event_id % 10
            WHEN 0 THEN concat('mshta.exe HTTPS://', host, '/a.hta')
            WHEN 5 THEN 'mshta.exe local.hta'
            WHEN 8 THEN 'rundll32.exe MSHTML,RunHTMLApplication javascript:new activexobject'
            WHEN 2 THEN concat('C:', $bs, 'WScript.exe ', $bs, $bs, host, '@80', $bs, 'x', event_id % 50, '.JSE')
            WHEN 7 THEN concat('wscript.exe ', $bs, $bs, host, $bs, 'x.jse')
            WHEN 3 THEN 'notepad.exe'
            WHEN 9 THEN 'rundll32.exe c:davclnt.dll,DavSetCookie nothing'
            ELSE concat('rundll32.exe C:', $bs, 'Windows', $bs, 'system32', $bs, 'davclnt.dll,DavSetCookie ',
                        host, ' http://', host, '/share/f', event_id % 3) END AS target_process_commandline,
       concat('u', event_id) AS target_process_uid,
       concat('h', event_id % 100) AS target_process_hash,
       concat('s', event_id % 100) AS target_process_hash_sha256
FROM ({_HOSTED_EVENTS}) AS hosted
"""

EDR_NETWORK = f"""
SELECT ts AS event_time,
       {_INITIATOR}
       concat('203.0.113.', event_id % 200) AS remote_ip,
       CAST(443 + event_id % 2 AS INT) AS remote_port,
       host AS domain,
       event_id % 2 = 0 AS is_inbound
FROM ({_HOSTED_EVENTS}) AS hosted
"""

EDR_FILE = f"""
SELECT ts AS event_time,
       concat('agent', user_id) AS agent_id,
       {_INITIATOR}
       'parent.exe' AS parent_process_name,
       CASE event_id % 6
            WHEN 0 THEN concat('proj-', user_id % 4, '-', lpad(CAST(event_id AS STRING), 11, 'a'), '.json')
            WHEN 1 THEN concat('proj-', user_id % 4, '-', lpad(CAST(event_id AS STRING), 12, 'A'), '.json')
            WHEN 2 THEN concat('other-', user_id % 4, '-', lpad(CAST(event_id AS STRING), 12, 'a'), '.json')
            ELSE concat('proj-', user_id % 4, '-', lpad(CAST(event_id AS STRING), 12, 'k'), '.json') END
           AS target_file_name,
       concat('C:', $bs, 'Users', $bs, host) AS target_file_path,
       CASE WHEN event_id % 8 = 3 THEN 'txt' ELSE 'json' END AS target_file_extension,
       concat('s', event_id % 100) AS target_file_hash_sha256,
       CASE event_id % 3 WHEN 0 THEN 'create' ELSE 'write' END AS target_file_action
FROM ({_HOSTED_EVENTS}) AS hosted
"""

# Four log rows per incident i: the RPC client, the COM host, the child, a registry write.
EDR_RAW = """
SELECT CASE role
            WHEN 0 THEN ts - CASE WHEN i % 6 = 0 THEN 601 WHEN i % 7 = 0 THEN 600 ELSE 60 END * $sec
            WHEN 2 THEN ts + CASE WHEN i % 5 = 0 THEN 601 WHEN i % 9 = 0 THEN 600 ELSE 30 END * $sec
            ELSE ts END AS event_time,
       CASE WHEN role = 3 THEN concat('agent', user_id) ELSE concat('aid', user_id) END AS aid,
       CASE WHEN role = 3 THEN CASE WHEN i % 11 = 0 THEN 'RegValueRead' ELSE 'RegValueUpdate' END
            WHEN event_type = 'view' THEN 'ThreadStart' ELSE 'ProcessRollup' END AS event_name,
       concat('image', role, '.exe') AS image_file_name,
       CASE WHEN role = 1 AND event_type <> 'click'
            THEN concat('C:', $bs, 'Windows', $bs, 'System32', $bs, 'DLLHOST.exe /Processid:{3E5FC7F9-9A51-4367-9063-',
                        CASE WHEN i % 8 = 0 THEN 'FFFFFFFFFFFF' ELSE 'A120244FBEC7' END, '}')
            ELSE concat('run ', i) END AS command_line,
       concat('p', i % 1000, '-', role) AS target_process_id,
       CASE WHEN role = 2 THEN concat('p', i % 1000, '-1') END AS parent_process_id,
       CASE WHEN role = 1 THEN concat('p', i % 1000, '-0') END AS rpc_client_process_id,
       concat('h', i % 100) AS target_process_hash,
       CASE WHEN i % 4 = 0 THEN 'medium_integrity' ELSE 'high_integrity' END AS integrity_level_description,
       CASE WHEN role = 3
            THEN concat('HKLM', $bs, 'software', $bs, 'Microsoft', $bs, 'Windows', $bs, 'CurrentVersion', $bs,
                        'Policies', $bs, CASE WHEN i % 13 = 0 THEN 'Other' ELSE 'System' END) END AS registry_key,
       CASE WHEN i % 5 = 0 THEN 'EnableLUA' ELSE 'ConsentPromptBehaviorAdmin' END AS registry_value_name,
       CASE WHEN role = 3 THEN concat('v', i % 3) END AS registry_str_value_data,
       CASE WHEN role = 3 THEN CAST(i % 3 AS INT) END AS registry_int_value_data,
       CASE WHEN i % 10 = 1 THEN '2' ELSE '1' END AS registry_operation_type,
       CASE WHEN i % 7 = 0 THEN 'gone' ELSE concat('u', i) END AS initiating_process_id
FROM (SELECT $spread event_id AS i, ts, user_id, event_type FROM $events) AS incidents
CROSS JOIN (VALUES (0), (1), (2), (3)) AS roles(role)
"""


def _numbers(count: int, name: str) -> str:
    return f"(VALUES {', '.join(f'({n})' for n in range(count))}) AS {name}s({name})"


# An error event is a burst of 6 to 14 files of its user, each fetched and then replaced or deleted.
O365_IMMEDIATE = f"""
SELECT CASE WHEN i % 97 <> 0 THEN ts + (n * 900 + step * 300) * $ms END AS event_time,
       CASE WHEN (i + n) % 101 = 0 THEN 'SharePoint' ELSE 'OneDrive' END AS workload,
       CASE step WHEN 0 THEN 'FileDownloaded'
            ELSE CASE (i + step) % 4 WHEN 0 THEN 'FileModified' WHEN 1 THEN 'FileDeleted' WHEN 2 THEN 'FileRenamed'
                 ELSE 'FileRecycled' END END AS operation,
       concat('10.9.0.', user_id % 3) AS client_ip,
       concat('user', user_id) AS user_id,
       concat('file', user_id, '-', i % 4, '-', n) AS object_id,
       concat('{{"SourceRelativeUrl": "folder', n % 7, '", "UserAgent": "agent', user_id % 2, '"}}') AS raw,
       CASE WHEN (i + n) % 5 = 0 THEN '{{"file_sync_bytes_committed": "7"}}' ELSE '{{}}' END AS record_specific_details
FROM (SELECT $spread event_id AS i, ts, user_id FROM $events WHERE event_type = 'error') AS bursts
CROSS JOIN {_numbers(14, "n")} CROSS JOIN {_numbers(3, "step")}
WHERE n < 6 + i % 9
"""

# A signup is a burst of 55 to 67 downloads and, up to eight days later, a burst on mostly the same files.
# A third of all bursts is one user's.
O365_STAGED = f"""
SELECT ts + (n * 500) * $ms + CASE WHEN stage = 1 THEN (i % 9 * 86400 + 600) ELSE 0 END * $sec AS event_time,
       CASE WHEN (i + n) % 101 = 0 THEN 'SharePoint' ELSE 'OneDrive' END AS workload,
       CASE WHEN stage = 0 THEN 'FileDownloaded' WHEN n % 3 = 0 THEN 'FileRecycled'
            WHEN i % 17 = 0 THEN 'FileRenamed' ELSE 'FileModified' END AS operation,
       concat('10.9.0.', user_id % 3) AS client_ip,
       CASE WHEN i % 3 = 0 THEN 'busy' ELSE concat('user', user_id) END AS user_id,
       concat('file', user_id, '-', i, '-', n + stage * (i % 7) * 3) AS object_id,
       concat('{{"SourceRelativeUrl": "folder', CASE WHEN i % 11 = 0 THEN 0 ELSE n % 7 END,
              '", "UserAgent": "agent', user_id % 2, '"}}') AS raw,
       '{{}}' AS record_specific_details
FROM (SELECT $spread event_id AS i, ts, user_id FROM $events WHERE event_type = 'signup') AS bursts
CROSS JOIN {_numbers(67, "n")} CROSS JOIN {_numbers(2, "stage")}
WHERE n < 55 + i % 13
"""

CLOUDTRAIL = """
SELECT CASE WHEN o_orderkey % 41 <> 0 THEN $t0 + o_orderkey * 5 * $sec END AS event_time,
       CASE WHEN o_orderkey % 29 = 0 THEN 'DeleteObjectTagging' WHEN o_orderkey % 37 = 0 THEN 'PutObjectAcl'
            ELSE CASE o_orderkey % 7
            WHEN 3 THEN CASE WHEN o_orderkey % 10 = 3 THEN 'DeleteObjects' ELSE 'GetObject' END
            WHEN 4 THEN 'PutObject'
            WHEN 5 THEN 'CopyObject'
            WHEN 6 THEN 'PutBucketLifecycle'
            ELSE 'DeleteObject' END END AS event_name,
       CASE WHEN o_orderkey % 31 = 0 THEN 'ec2.amazonaws.com' ELSE 's3.amazonaws.com' END AS event_source,
       concat('us-east-', o_orderkey % 2) AS aws_region,
       CASE o_custkey % 6
            WHEN 0 THEN NULL
            WHEN 1 THEN 'config.amazonaws.com'
            WHEN 2 THEN '198.18.0.1'
            WHEN 3 THEN '198.18.0.1'
            ELSE concat('10.1.0.', o_custkey % 12) END AS source_ip_address,
       'aws-cli/2' AS user_agent,
       CASE WHEN o_custkey % 2 = 0 THEN 'AssumedRole' ELSE 'IAMUser' END AS user_identity_type,
       concat('arn:aws:sts::1:assumed-role/role', o_custkey % 2, '/session') AS user_identity_arn,
       concat('name', o_custkey % 2) AS user_identity_user_name,
       concat('AK', o_custkey % 2) AS user_identity_access_key_id,
       '222233334444' AS recipient_account_id,
       CASE WHEN o_orderkey % 9 = 0 THEN 'AccessDenied' END AS error_code,
       concat('key', o_orderkey % 5000) AS object_key,
       CASE WHEN o_orderkey % 8 <> 0 THEN 'arn:aws:kms:key' END AS response_kms_key,
       CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'alias/aws/s3' ELSE 'alias/other' END AS request_kms_key_alias,
       CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '111111111111' WHEN 2 THEN '222222222222'
            ELSE '999999999999' END AS request_kms_key_aws_account,
       CASE WHEN o_orderkey % 13 = 0
            THEN concat('{"bucketName": "bucket', o_custkey % 2,
                        '", "LifecycleConfiguration": {"Rule": [{"Expiration": {"Days": 1}, "Status": "Enabled"}]}}')
            ELSE concat('{"bucketName": "bucket', o_custkey % 2,
                        '", "LifecycleConfiguration": {"Rule": {"Expiration": {"Days": ', o_orderkey % 12,
                        '}, "Status": "', CASE WHEN o_orderkey % 4 = 0 THEN 'Disabled' ELSE 'Enabled' END,
                        '"}}}') END AS request_parameters
FROM $orders
"""

VIEWS = {
    "gcp_audit": GCP_AUDIT,
    "gsuite_activity": GSUITE_ACTIVITY,
    "org_ip": ORG_IP,
    "edr_process": EDR_PROCESS,
    "edr_network": EDR_NETWORK,
    "edr_file": EDR_FILE,
    "edr_raw": EDR_RAW,
    "o365_immediate": O365_IMMEDIATE,
    "o365_staged": O365_STAGED,
    "cloudtrail": CLOUDTRAIL,
}

_SPARK = {"t0": "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "ms": "INTERVAL '0.001' SECOND"}
_ORACLE = {"t0": "TIMESTAMP '2024-01-01 00:00:00'", "ms": "INTERVAL '1' MILLISECOND", "spread": "/* */"}
_SHARED = {"bs": BACKSLASH, "sec": "INTERVAL '1' SECOND"}


def _fill(text: str, tokens: dict[str, str], table) -> str:
    values = {**_SHARED, **tokens}
    return re.sub(r"\$(\w+)", lambda found: values.get(found[1]) or table(found[1]), text)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived source, checked against its schema and with its documents parsed."""
    # A table that comes in one file is dealt out before its rows are unfolded.
    tokens = {**_SPARK, "spread": f"/*+ REPARTITION({2 * spark.sparkContext.defaultParallelism}) */"}
    df = spark.sql(_fill(VIEWS[name], tokens, lambda table: f"parquet.`{sf_dir}/{table}.parquet`"))
    source = "o365_audit" if name.startswith("o365") else name
    assert source in SCHEMAS
    return conform(df, source)


def oracle_views(*names: str) -> str:
    """The same sources as common table expressions."""
    parts = [f"{name} AS ({_fill(VIEWS[name], _ORACLE, lambda table: table)})" for name in names]
    return "WITH " + ",\n".join(parts)
