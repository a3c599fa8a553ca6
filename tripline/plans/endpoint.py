"""Detections over endpoint telemetry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.predicates import ilike_any, ilike_raw, is_internal_host, like_raw
from tripline.functions.text import remote_host
from tripline.functions.timeops import span, recent
from tripline.operators.intervals import interval_join
from tripline.operators.sizing import narrow_to_keys
from tripline.operators.workdir import WorkDir

# Patterns are raw, a backslash is just a backslash.
WINDOWS = "WINDOWS"
REMOTE_SCRIPT = r"%wscript.exe%\%@%\%.jse%"
DAV_CLIENT = r"%rundll32.exe %\windows\system32\davclnt.dll,%davsetcookie %"
DAV_INITIATOR = "svchost.exe"
COM_HOST = r"%\WINDOWS\system32\DllHost.exe /Processid:{3E5FC7F9-9A51-4367-9063-A120244FBEC7}"
PROCESS_EVENTS = "Process%"
HIGH_INTEGRITY = "high_integrity"
REGISTRY_EVENTS = "%reg%update%"
CONSENT_KEY = r"%\SOFTWARE\Microsoft\Windows\CurrentVersion\Policies\System"
CONSENT_VALUE = "ConsentPromptBehaviorAdmin"
CONSENT_OFF = 0
VALUE_SET = "1"
HTA_HOST = "mshta.exe"
HTA_THROUGH_DLL = "%rundll%mshtml%"
HTA_ARGUMENTS = ("%http%", "%ActiveXObject%", "%wscript%", r"%users\public%")


def webdav_script_execution(edr_process: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Process starts that run an encoded script from a remote share."""
    return (
        recent(edr_process, "event_time", days, as_of)
        .where(like_raw(F.lower("target_process_commandline"), REMOTE_SCRIPT))
        .select("event_time", "agent_id", "target_process_commandline")
        .distinct()
        .orderBy("event_time")
    )


def webdav_retrieval_hosts(edr_process: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """External hosts that files were fetched from through the WebDAV client."""
    host = F.col("target_server")
    return (
        recent(edr_process, "event_time", days, as_of)
        .where(
            (F.col("device_platform") == WINDOWS)
            & ((F.col("initiating_process_name") == DAV_INITIATOR) | F.col("initiating_process_name").isNull())
            & like_raw(F.lower("target_process_commandline"), DAV_CLIENT)
        )
        .select(
            remote_host("target_process_commandline").alias("target_server"),
            "agent_id",
            "target_process_commandline",
        )
        .where(host.contains(".") & ~is_internal_host(host))
        # The log is reduced to few rows first; the distinct counts expand only those.
        .groupBy("target_server", "agent_id", F.lower("target_process_commandline").alias("_lowered"))
        .agg(F.min("target_process_commandline").alias("_example"))
        .groupBy("target_server")
        .agg(
            F.count_distinct("agent_id").alias("distinct_aids"),
            F.count_distinct("_lowered").alias("distinct_cmdlines"),
            F.min("_example").alias("example_target_process_commandline"),
        )
        .orderBy("target_server")
    )


def elevated_com_children(
    edr_raw: DataFrame, as_of: datetime | str, work: WorkDir, days: int = 30, within_seconds: int = 600
) -> DataFrame:
    """High-integrity children of an auto-elevating COM host, with the host's RPC client.

    The child starts at most ``within_seconds`` after the host, the client at
    most as long before it; a host whose client is not in the log is kept.
    Hosts are rare, so they are written to ``work`` once, and one pass over the
    other processes keeps the possible children and clients there. Both happens
    when the job is called; the result reads from ``work``.
    """
    processes = recent(edr_raw, "event_time", days, as_of).where(like_raw("event_name", PROCESS_EVENTS))
    hosts = work.store(
        processes.where(ilike_raw("command_line", COM_HOST)).select(
            F.col("aid").alias("host_aid"),
            F.col("event_time").alias("host_time"),
            F.col("target_process_id").alias("host_pid"),
            F.col("rpc_client_process_id").alias("client_pid_of_host"),
        ),
        "hosts",
    )
    related = narrow_to_keys(
        processes.select(
            "event_time",
            "aid",
            "event_name",
            "image_file_name",
            "command_line",
            "target_process_hash",
            "target_process_id",
            "parent_process_id",
            "integrity_level_description",
        ),
        [
            {"aid": "host_aid", "parent_process_id": "host_pid"},
            {"aid": "host_aid", "target_process_id": "client_pid_of_host"},
        ],
        hosts,
        work,
    )
    children = related.where(F.col("integrity_level_description") == HIGH_INTEGRITY).select(
        F.col("event_time").alias("elevated_process_creation_time"),
        F.col("aid").alias("agent_id"),
        F.col("parent_process_id").alias("child_parent_pid"),
        "event_name",
        F.col("command_line").alias("elevated_process_command_line"),
        F.col("target_process_hash").alias("elevated_process_hash"),
        F.col("integrity_level_description").alias("target_elevated_proc_integrity_level"),
    )
    clients = related.select(
        F.col("event_time").alias("client_time"),
        F.col("aid").alias("client_aid"),
        F.col("target_process_id").alias("client_pid"),
        F.col("image_file_name").alias("uac_bypass_initiating_process_name"),
        F.col("command_line").alias("uac_bypass_initiating_command_line"),
        F.col("target_process_hash").alias("initiating_process_hash"),
    )
    with_child = interval_join(
        hosts,
        children,
        {"host_aid": "agent_id", "host_pid": "child_parent_pid"},
        "host_time",
        "elevated_process_creation_time",
        0,
        within_seconds,
    )
    with_client = interval_join(
        with_child,
        clients,
        {"host_aid": "client_aid", "client_pid_of_host": "client_pid"},
        "host_time",
        "client_time",
        -within_seconds,
        0,
        how="left",
    )
    return (
        with_client.select(
            "elevated_process_creation_time",
            "agent_id",
            "event_name",
            "elevated_process_command_line",
            "elevated_process_hash",
            "target_elevated_proc_integrity_level",
            "uac_bypass_initiating_process_name",
            "uac_bypass_initiating_command_line",
            "initiating_process_hash",
        )
        .distinct()
        .orderBy("elevated_process_creation_time")
    )


def consent_prompt_disabled(
    edr_raw: DataFrame,
    edr_process: DataFrame,
    as_of: datetime | str,
    work: WorkDir,
    days: int = 30,
    within_seconds: int | None = None,
) -> DataFrame:
    """Registry writes that switch the administrator consent prompt off, with the writing process.

    With ``within_seconds`` a process only counts as the writer if the log has it at most so long before the write
    or at the same time; by default whenever it has it. Writes are rare and stored in ``work`` once, and so is what the process log
    has of the processes they name, when the job is called.
    """
    writes = work.store(
        recent(edr_raw, "event_time", days, as_of)
        .where(
            (F.col("registry_value_name") == CONSENT_VALUE)
            & (F.col("registry_operation_type") == VALUE_SET)
            & (F.col("registry_int_value_data") == CONSENT_OFF)
            & ilike_raw("registry_key", CONSENT_KEY)
            & like_raw(F.lower("event_name"), REGISTRY_EVENTS)
        )
        .select(
            "event_time",
            "aid",
            "event_name",
            "registry_key",
            "registry_value_name",
            "registry_str_value_data",
            "registry_int_value_data",
            "registry_operation_type",
            "initiating_process_id",
        )
        .distinct(),
        "writes",
    )
    processes = recent(edr_process, "event_time", days, as_of).select(
        "agent_id",
        "target_process_uid",
        F.col("target_process_commandline").alias("initiating_process_command_line"),
        F.col("target_process_hash").alias("initiating_process_hash"),
        F.col("event_time").alias("_process_time"),
    )
    on = {"agent_id": "aid", "target_process_uid": "initiating_process_id"}
    processes = narrow_to_keys(processes, [on], writes, work)
    same_process = [F.col(a) == F.col(b) for a, b in on.items()]
    if within_seconds is not None:
        earliest = F.col("event_time") - span(within_seconds, "SECOND")
        same_process.append(F.col("_process_time").between(earliest, F.col("event_time")))
    found = writes.join(processes, same_process, "left")
    return found.drop("agent_id", "target_process_uid", "_process_time").orderBy("event_time")


def _runs_hta(process: str, command_line: str) -> Column:
    return (F.lower(process) == HTA_HOST) | like_raw(F.lower(command_line), HTA_THROUGH_DLL)


def _hta_activity(
    df: DataFrame,
    process: str,
    command_line: str,
    columns: list[str],
    as_of: datetime | str,
    days: int,
    limit: int | None,
    distinct: bool,
) -> DataFrame:
    """Suspicious activity of HTA hosts: all of it, or the earliest ``limit`` rows with ties in column order."""
    found = (
        recent(df, "event_time", days, as_of, inclusive=True)
        .where(
            (F.col("device_platform") == WINDOWS)
            & _runs_hta(process, command_line)
            & ilike_any(command_line, HTA_ARGUMENTS)
        )
        .select(*columns)
    )
    found = found.distinct() if distinct else found
    return found if limit is None else found.orderBy(*columns).limit(limit)


def hta_target(
    edr_process: DataFrame, as_of: datetime | str, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Starts of an HTA host with suspicious arguments."""
    columns = ["event_time", "initiating_process_name", "target_process_commandline", "target_process_uid"]
    return _hta_activity(
        edr_process, "target_process_name", "target_process_commandline", columns, as_of, days, limit, True
    )


def hta_children(
    edr_process: DataFrame, as_of: datetime | str, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Processes started by an HTA host that has suspicious arguments."""
    columns = ["event_time", "initiating_process_name", "target_process_commandline", "target_process_uid"]
    return _hta_activity(
        edr_process, "initiating_process_name", "initiating_process_commandline", columns, as_of, days, limit, True
    )


def hta_network(
    edr_network: DataFrame, as_of: datetime | str, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Network connections of an HTA host that has suspicious arguments."""
    columns = [
        "event_time",
        "initiating_process_commandline",
        "remote_ip",
        "remote_port",
        "domain",
        "is_inbound",
    ]
    return _hta_activity(
        edr_network, "initiating_process_name", "initiating_process_commandline", columns, as_of, days, limit, False
    )


def hta_files(edr_file: DataFrame, as_of: datetime | str, days: int = 30, limit: int | None = None) -> DataFrame:
    """File activity of an HTA host that has suspicious arguments."""
    columns = ["event_time", "initiating_process_commandline", "target_file_action", "target_file_path"]
    return _hta_activity(
        edr_file, "initiating_process_name", "initiating_process_commandline", columns, as_of, days, limit, False
    )
