"""Incremental runs as Structured Streaming: offsets live in the checkpoint, sinks run per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, checkpoint: str, send: Callable[[DataFrame], None], *, steps: list[Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Processes everything that is new since the last call and stops; a failed batch is repeated (at least once)."""
    for step in steps or []:
        stream = stream.transform(step)

    def batch(rows: DataFrame, number: int) -> None:
        send(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped, as a cursor would have dropped them."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), by, "n", "total")
    )
