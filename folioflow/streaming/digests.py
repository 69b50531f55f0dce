"""Candidates that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_digests(candidates: DataFrame, time_col: str, key_col: str, handle: Callable[[DataFrame, int], None], checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """Hand each batch of new candidates to `handle`, every key once within the time that rows may be late.

    candidates: a streaming DataFrame. The state holds the keys of `late` time
    only; all rows that are there are handled, then the query ends.
    """
    fresh = candidates.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key_col])
    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
