"""Text predicates whose patterns are raw: a backslash is just a backslash."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's LIKE takes a backslash as its escape unless another one is named.
_ESCAPES = "~^!#"


def _unused_escape(pattern: str) -> Column:
    for mark in _ESCAPES:
        if mark not in pattern:
            return F.lit(mark)
    raise ValueError(f"no free escape character for {pattern!r}")


def like_raw(column: Column | str, pattern: str) -> Column:
    """LIKE without an escape character."""
    return F.like(column, F.lit(pattern), _unused_escape(pattern))


def ilike_raw(column: Column | str, pattern: str) -> Column:
    """Case-blind LIKE without an escape character."""
    return F.ilike(column, F.lit(pattern), _unused_escape(pattern))


def ilike_any(column: Column | str, patterns: tuple[str, ...]) -> Column:
    """True when any of the patterns fits, ignoring case."""
    return reduce(or_, [ilike_raw(column, pattern) for pattern in patterns])


def full_match(column: Column | str, pattern: str) -> Column:
    r"""Regex over the whole string. ``$`` would also fit before a last newline, ``\z`` does not."""
    return F.rlike(column, F.lit(rf"\A(?:{pattern})\z"))


# Hosts that are not on the public internet.
INTERNAL_PREFIXES = (
    "10.",
    "192.168.",
    "127.",
    "169.254.",
    "0.",
    "192.0.0.",
    "192.0.2.",
    "192.88.99.",
    "198.51.100.",
    "203.0.113.",
    "233.252.0.",
    "fc00",
    "fe80",
    "ff00",
    "localhost:",
)
# Leading text, then the lowest and highest number of the next octet.
INTERNAL_OCTET_RANGES = (
    ("172.", 16, 31),
    ("100.", 64, 127),
    ("198.", 18, 19),
    ("", 224, 239),
    ("", 240, 255),
)
INTERNAL_NAMES = ("localhost",)


def _internal_host_regex() -> str:
    def quote(text: str) -> str:
        return text.replace(".", r"\.")

    heads = [quote(prefix) for prefix in INTERNAL_PREFIXES]
    for lead, low, high in INTERNAL_OCTET_RANGES:
        octets = "|".join(str(number) for number in range(low, high + 1))
        heads.append(rf"{quote(lead)}(?:{octets})\.")
    names = [rf"{quote(name)}\z" for name in INTERNAL_NAMES]
    return rf"\A(?:{'|'.join(heads + names)})"


def is_internal_host(host: Column | str) -> Column:
    """One anchored pass over the head of a lower-case host name or address."""
    return F.rlike(host, F.lit(_internal_host_regex()))
