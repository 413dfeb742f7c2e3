"""The incremental protocol of polled sources, as joins and grouped maxima over a cursor table.

A cursor table has a row per partition key (a country, a mailbox, a post, a feed): key, since_time
and since_id. Records at or before their key's cursor are dropped; new cursors are the maxima of
what was read, never going back.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.functions.times import DEFAULT_LOOKBACK, parse_time

CURSORS = "key string, since_time timestamp, since_id string"


def start_time(lookup_period: str | None, now: datetime | None = None) -> datetime:
    """Where a source without a cursor begins."""
    return parse_time(lookup_period or DEFAULT_LOOKBACK, now or datetime.now(timezone.utc))


def newer(records: DataFrame, cursors: DataFrame | None, since: datetime, *, key: str = "key", ts: str = "ts", record_id: str | None = None) -> DataFrame:
    """Records after their key's cursor (after ``since`` where there is none), without the record the cursor names."""
    stamp = F.lit(since.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    if cursors is None:
        return records.where(F.col(ts) > stamp)
    own = cursors.select(F.col("key").alias("__key"), F.col("since_time").alias("__since"), F.col("since_id").alias("__id"))
    found = records.join(own, F.col(key) == F.col("__key"), "left").where(F.col(ts) > F.coalesce("__since", stamp))
    if record_id:
        found = found.where(~F.col(record_id).cast("string").eqNullSafe(F.col("__id")) | F.col("__id").isNull())
    return found.drop("__key", "__since", "__id")


def advance(records: DataFrame, cursors: DataFrame | None = None, *, key: str = "key", ts: str = "ts", record_id: str = "id") -> DataFrame:
    """The cursor table after ``records``: per key the latest time and the id seen then (the largest of ties)."""
    seen = records.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("since_time"), F.col(record_id).cast("string").alias("since_id")).where("since_time is not null")
    if cursors is not None:
        seen = seen.unionByName(cursors.select("key", "since_time", "since_id"))
    return seen.groupBy("key").agg(F.max(F.struct("since_time", "since_id")).alias("top")).select("key", "top.since_time", "top.since_id")


def newest(records: DataFrame, n: int, *, key: str = "key", ts: str = "ts", record_id: str = "id") -> DataFrame:
    """The ``n`` newest records of each key."""
    order = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(record_id).desc())
    return records.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
