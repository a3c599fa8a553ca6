"""Keys seen for the first time, or again after a long silence, with one state row per bucket of keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripline.functions.timeops import utc_instant
from tripline.streaming.events import timed

#: What ``transformWithState`` needs; it is read when a stream starts.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class _LastSeen(StatefulProcessor):
    """Remembers when the keys of a bucket were last seen and passes on the slices that begin a new appearance.

    A bucket's keys are one state row, so that a run pays for a few calls per bucket and not per key.
    """

    def __init__(self, silence: int | None, slice_seconds: int):
        self._silence = None if silence is None else silence * 1_000_000
        self._slice = slice_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("last", "keys array<string>, micros array<long>")

    def _known(self) -> dict[str, int]:
        return dict(zip(*self._state.get())) if self._state.exists() else {}

    def _keep(self, last: dict[str, int]) -> None:
        if last:
            self._state.update((list(last), list(last.values())))
        else:
            self._state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices = pd.concat(list(rows)).sort_values("begins", kind="stable")
        last = self._known()
        timer = self._timer(last)
        new = []
        for one, begin, end in zip(slices["key"].tolist(), slices["begins"].tolist(), slices["ends"].tolist()):
            before = last.get(one)
            new.append(before is None or (self._silence is not None and begin - before > self._silence))
            last[one] = end if before is None else max(before, end)
        self._keep(last)
        if self._timer(last) != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(self._timer(last))
        yield slices[new]

    def _forgotten(self, last: int) -> int:
        """Watermark in ms at which all slices are closed that can hold an event within the silence."""
        return (last + self._silence + self._slice) // 1000 + 1

    def _timer(self, last: dict[str, int]) -> int | None:
        """When the first of the keys is forgotten."""
        return self._forgotten(min(last.values())) if last and self._silence is not None else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A forgotten key counts as new from now on, with its state or without it.
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        last = {one: micros for one, micros in self._known().items() if self._forgotten(micros) > now}
        self._keep(last)
        if last:
            self._handle.registerTimer(self._timer(last))
        yield from ()

    def close(self) -> None:
        pass


def _as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError("keys and ties must be scalars")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")


def _from_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(column.cast("long"))
    return F.unhex(column) if isinstance(kind, T.BinaryType) else column.cast(kind)


def _one_text(columns: list[Column]) -> Column:
    """Texts that may be NULL as one text, different for different ones: each with its length in front."""
    return F.concat(*[F.coalesce(F.concat(F.length(one).cast("string"), F.lit(":"), one), F.lit("-")) for one in columns])


def first_seen_stream(
    stream: DataFrame,
    keys: list[str],
    time_col: str,
    tie_break: list[str],
    lateness: int,
    *,
    slice_seconds: int = 3600,
    silence: int | None = None,
    buckets: int = 512,
) -> DataFrame:
    """The events that show a key for the first time: the columns ``keys``, ``time_col``, ``tie_break``.

    With ``silence`` (seconds, at least a slice) a key that was not seen for
    longer than that is new again, and its state is removed after that time, so
    state is bounded by the keys of one such period. Without it, each key is
    reported once and keeps itself and one long for good. Ties go to the smallest
    ``tie_break``. Events behind the watermark are late: left out and reported. A
    NULL key is a key. Needs ``STATE_STORE``.

    Events reach the state only as the first event and the last time of a key
    in a slice of time. That is partially aggregated before the shuffle, so a
    hot key moves one row per slice and task. Slices close in the order of time,
    which puts a key's events into order without a buffer.

    Keys are dealt to ``buckets`` by hash. A run reads and writes the state of
    every bucket that has events, so there should be enough of them that one
    holds thousands of keys, not millions; a checkpoint keeps the number it began with.
    """
    if silence is not None and silence < slice_seconds:
        raise ValueError("the silence must last for a slice at least")
    shown = F.struct(time_col, *tie_break)
    micros = lambda column: F.unix_micros(utc_instant(column))
    slices = (
        timed(stream, time_col, lateness, "_at")
        .groupBy(F.window("_at", f"{int(slice_seconds)} seconds").alias("_slice"), *keys)
        .agg(F.min(shown).alias("_first"), F.max(time_col).alias("_last"))
        .select(F.window_time("_slice"), *keys, "_first.*", micros(F.col("_first")[time_col]), micros("_last"))
    )
    # Python renames columns whose names are no plain words and turns numbers that may be NULL into others, so columns go by
    # number and as text there.
    names = [*keys, time_col, *tie_break]
    kinds = [stream.schema[name].dataType for name in names]
    numbers = [f"c{number}" for number in range(len(names))]
    fields = ", ".join(f"{number} string" for number in numbers)
    return (
        slices.toDF("at", *numbers, "begins", "ends")
        .withColumns({number: _as_text(F.col(number), kind) for number, kind in zip(numbers, kinds)})
        .withColumn("key", _one_text([F.col(number) for number in numbers[: len(keys)]]))
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            _LastSeen(silence, slice_seconds),
            f"at timestamp, {fields}, begins long, ends long, key string, bucket long",
            outputMode="Append",
            timeMode="EventTime",
        )
        .select(*[_from_text(F.col(number), kind).alias(name) for number, kind, name in zip(numbers, kinds, names)])
    )
