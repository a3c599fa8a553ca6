"""Pieces of delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(column: Column | str, separator: str, number: int) -> Column:
    """Piece ``number`` counted from 1, or from the end when negative; '' when there is none."""
    return F.split_part(column, F.lit(separator), F.lit(number))


def last_part(column: Column | str, separator: str) -> Column:
    return part(column, separator, -1)


def remote_host(command_line: Column | str) -> Column:
    """Lower-case host of the first ``//host/...`` in a command line."""
    return part(part(F.lower(command_line), "//", 2), "/", 1)


def role_of_session(identity_type: Column | str, arn: Column | str) -> Column:
    """Role name inside the ARN of an assumed-role session, else NULL."""
    identity_type = F.col(identity_type) if isinstance(identity_type, str) else identity_type
    return F.when(identity_type == "AssumedRole", part(arn, "/", 2))
