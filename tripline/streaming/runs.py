"""Running a stream over what has arrived since the last run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tripline.session import settings


#: A run's figures are sums over its batches, so Spark has to keep all of them.
_ALL_PROGRESS = {"spark.sql.streaming.numRecentProgressUpdates": "1000000"}


@dataclass(frozen=True)
class Drained:
    """What a run did: rows read, rows that were late, rows left in state."""

    rows: int
    late: int
    state_rows: int


def drain(found: DataFrame, path: str, checkpoint: str, state_store: dict[str, str] | None = None) -> Drained:
    """Process all files that are there, append the result to the Parquet folder ``path`` and stop.

    The offsets, the watermark and all state are in ``checkpoint``, so the next
    run, or one after a crash, goes on where this one stopped, and the sink's own
    log keeps a repeated batch from being written twice. Both folders must be
    shared storage. ``late`` counts what the stream's first stateful operator
    dropped: events, or partial aggregates of them. ``state_store`` holds settings
    that the stream's operators ask for.
    """
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with settings(found.sparkSession, {**_ALL_PROGRESS, **(state_store or {})}):
        query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    progress = [json.loads(one.json) for one in query.recentProgress]
    operators = [one["stateOperators"] for one in progress if one["stateOperators"]]
    return Drained(
        rows=sum(one["numInputRows"] for one in progress),
        late=sum(each[-1]["numRowsDroppedByWatermark"] for each in operators),
        state_rows=sum(each["numRowsTotal"] for each in operators[-1]) if operators else 0,
    )
