"""Event time: look-back filters, tumbling slices, day differences.

Event times are zone-free (``timestamp_ntz``), so no result depends on the
session time zone. "Now" is always an argument.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
MICROS_PER_DAY = SECONDS_PER_DAY * 1_000_000
HOUR = 3600
FIRST_EPOCH_SECOND = -62135596800  # 0001-01-01 00:00:00
LAST_EPOCH_SECOND = 253402300799  # 9999-12-31 23:59:59


def as_ntz(moment: datetime | str) -> Column:
    """A zone-free timestamp literal."""
    text = moment.isoformat(sep=" ") if isinstance(moment, datetime) else moment
    return F.lit(text).cast("timestamp_ntz")


def span(amount: int, unit: str) -> Column:
    """An interval literal, for example ``span(10, 'MINUTE')``."""
    return F.expr(f"INTERVAL '{int(amount)}' {unit}")


def recent(
    df: DataFrame,
    time_col: str,
    days: int,
    as_of: datetime | str,
    *,
    inclusive: bool = False,
) -> DataFrame:
    """Rows later than ``as_of`` minus ``days``."""
    bound = as_ntz(as_of) - span(days, "DAY")
    column = F.col(time_col)
    return df.where(column >= bound if inclusive else column > bound)


def within(df: DataFrame, time_col: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows whose time lies in a closed range."""
    return df.where(F.col(time_col).between(as_ntz(start), as_ntz(end)))


@dataclass(frozen=True)
class DayFolders:
    """How a log is cut into day folders: the column, and by how many days it may differ from the event time.

    The margin covers folders that count days in another zone or by arrival.
    Rows without a day are always read.
    """

    column: str = "event_date"
    margin_days: int = 1

    def since(self, df: DataFrame, start: datetime | str) -> DataFrame:
        """Leave out the folders of days before ``start`` minus the margin, without listing or opening them."""
        first = (as_ntz(start) - span(self.margin_days, "DAY")).cast("date")
        return df.where(F.col(self.column).isNull() | (F.col(self.column) >= first))

    def until(self, df: DataFrame, end: datetime | str) -> DataFrame:
        """Leave out the folders of days after ``end`` plus the margin."""
        last = (as_ntz(end) + span(self.margin_days, "DAY")).cast("date")
        return df.where(F.col(self.column).isNull() | (F.col(self.column) <= last))


def time_slice(time: Column | str, seconds: int) -> Column:
    """Start of the tumbling slice of ``seconds`` that holds ``time``; NULL for a NULL time.

    The end of a slice is its start plus its size. Slicing an end again would
    push an end that lies on a boundary into the next slice.
    """
    return from_epoch_seconds(F.floor(epoch_seconds(time) / seconds) * seconds)


def days_between(earlier: Column | str, later: Column | str) -> Column:
    """Number of midnights between two times (23:59 to 00:01 is one day)."""
    return F.datediff(later, earlier)


def utc_ntz(time: Column) -> Column:
    """Zone-free UTC time of an instant (``timestamp``), whatever the session's zone is."""
    micros = F.unix_micros(time)
    day, rest = F.floor(micros / MICROS_PER_DAY), F.pmod(micros, F.lit(MICROS_PER_DAY))
    seconds = (rest.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return as_ntz("1970-01-01 00:00:00") + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), seconds)


def utc_instant(time: Column | str) -> Column:
    """The instant (``timestamp``) of a zone-free UTC time, whatever the session's zone is; ``utc_ntz`` leads back.

    Streams need it: a watermark can only stand on instants.
    """
    time = F.col(time) if isinstance(time, str) else time
    micros = ((F.extract(F.lit("SECOND"), time) - F.second(time)) * 1_000_000).cast("long")
    return F.timestamp_micros(epoch_seconds(time) * 1_000_000 + micros)


def epoch_seconds(time: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-free time, independent of any zone."""
    time = F.col(time) if isinstance(time, str) else time
    day = F.unix_date(time.cast("date")).cast("long")
    return day * SECONDS_PER_DAY + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def from_epoch_seconds(seconds: Column) -> Column:
    """Zone-free time of an epoch second; NULL outside the years 1 to 9999."""
    day = F.floor(seconds / SECONDS_PER_DAY).cast("int")
    offset = F.make_dt_interval(day, F.lit(0), F.lit(0), F.pmod(seconds, F.lit(SECONDS_PER_DAY)).cast("decimal(18,6)"))
    return F.when(
        seconds.between(FIRST_EPOCH_SECOND, LAST_EPOCH_SECOND), as_ntz("1970-01-01 00:00:00") + offset
    )
