"""Streaming forms of the jobs' patterns: bursts, interval joins and first-seen keys over logs that keep growing.

Each gives the rows of its batch form for every event that is not late. State
is bounded by the watermark, so an event may only count up to a stated delay.
"""

from tripline.streaming.bursts import burst_stream
from tripline.streaming.first_seen import first_seen_stream
from tripline.streaming.jobs import foreign_kms_encryption_stream, object_deletion_burst_stream
from tripline.streaming.joins import interval_join_stream
from tripline.streaming.runs import Drained, drain

__all__ = [
    "Drained",
    "burst_stream",
    "drain",
    "first_seen_stream",
    "foreign_kms_encryption_stream",
    "interval_join_stream",
    "object_deletion_burst_stream",
]
