"""Schemas of the log tables and lookups.

Every log has one zone-free event time in UTC; an instant (``timestamp``) is
turned into one, whatever the session's zone is. Documents are ``variant``; a
table that stores them as JSON text is accepted and parsed on load. Logs may
carry further columns, which are left out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tripline.functions.docs import with_documents
from tripline.functions.timeops import DayFolders, utc_ntz
from tripline.sources.file_times import FileTimes


def _schema(strings: str = "", times: str = "", ints: str = "", booleans: str = "", documents: str = "") -> T.StructType:
    fields = [T.StructField(name, T.TimestampNTZType()) for name in times.split()]
    fields += [T.StructField(name, T.StringType()) for name in strings.split()]
    fields += [T.StructField(name, T.IntegerType()) for name in ints.split()]
    fields += [T.StructField(name, T.BooleanType()) for name in booleans.split()]
    fields += [T.StructField(name, T.VariantType()) for name in documents.split()]
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "gcp_audit": _schema(
        times="event_time",
        strings="project_id principal_email caller_ip caller_user_agent service_name method_name",
        documents="resource proto_payload",
    ),
    "gsuite_activity": _schema(
        times="id_time",
        strings="id_application_name actor_email ip_address event_name event_type",
        documents="event_parameters",
    ),
    "org_ip": _schema(strings="ip specific_source_type"),
    "edr_process": _schema(
        times="event_time",
        strings=(
            "agent_id device_platform initiating_process_name initiating_process_commandline"
            " target_process_name target_process_commandline target_process_uid"
            " target_process_hash target_process_hash_sha256"
        ),
    ),
    "edr_network": _schema(
        times="event_time",
        strings="device_platform initiating_process_name initiating_process_commandline remote_ip domain",
        ints="remote_port",
        booleans="is_inbound",
    ),
    "edr_file": _schema(
        times="event_time",
        strings=(
            "agent_id device_platform parent_process_name initiating_process_name"
            " initiating_process_commandline target_file_name target_file_path"
            " target_file_extension target_file_hash_sha256 target_file_action"
        ),
    ),
    "edr_raw": _schema(
        times="event_time",
        strings=(
            "aid event_name image_file_name command_line target_process_id parent_process_id"
            " rpc_client_process_id target_process_hash integrity_level_description registry_key"
            " registry_value_name registry_str_value_data registry_operation_type initiating_process_id"
        ),
        ints="registry_int_value_data",
    ),
    "o365_audit": _schema(
        times="event_time",
        strings="workload operation client_ip user_id object_id",
        documents="raw record_specific_details",
    ),
    "cloudtrail": _schema(
        times="event_time",
        strings=(
            "event_name event_source aws_region source_ip_address user_agent user_identity_type"
            " user_identity_arn user_identity_user_name user_identity_access_key_id"
            " recipient_account_id error_code object_key response_kms_key request_kms_key_alias"
            " request_kms_key_aws_account"
        ),
        documents="request_parameters",
    ),
}

DOCUMENT_COLUMNS = {
    name: tuple(field.name for field in schema.fields if isinstance(field.dataType, T.VariantType))
    for name, schema in SCHEMAS.items()
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check and order the columns of a source; parse text documents, turn instants into UTC times."""
    schema = SCHEMAS[name]
    missing = [field.name for field in schema.fields if field.name not in df.columns]
    if missing:
        raise ValueError(f"source {name!r} lacks the columns {', '.join(missing)}")
    df = with_documents(df, *DOCUMENT_COLUMNS[name])
    wanted = []
    for field in schema.fields:
        column, kind = df[field.name], df.schema[field.name].dataType
        if kind == T.TimestampType() and field.dataType == T.TimestampNTZType():
            column = utc_ntz(column).alias(field.name)
        elif kind != field.dataType:
            column = column.cast(field.dataType).alias(field.name)
        wanted.append(column)
    return df.select(*wanted)


def load_source(
    spark: SparkSession,
    name: str,
    location: str,
    fmt: str = "parquet",
    *,
    folders: DayFolders | None = None,
    file_times: FileTimes | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """Read a source from a folder, or from a catalog table when ``fmt`` is 'table'.

    With ``folders``, a table cut into day folders is read from ``since`` to
    ``until`` only, give or take the margin stated there. The jobs' own
    look-backs on the event time still apply. With ``file_times``, only the files
    are opened that hold an event of that range.
    """
    if file_times:
        files = file_times.files(since, until)
        if not files:
            return spark.createDataFrame([], SCHEMAS[name])
        return conform(spark.read.format(fmt).load(files), name)
    df = spark.read.table(location) if fmt == "table" else spark.read.format(fmt).load(location)
    if folders and since is not None:
        df = folders.since(df, since)
    if folders and until is not None:
        df = folders.until(df, until)
    return conform(df, name)
