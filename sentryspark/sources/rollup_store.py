"""Roll-ups kept as states per batch, merged when read or for one refresh window.

Each ingest batch commits the states of its own events, in day folders. A roll-up of any range
is the merge of the states of that range; nothing reads the stored events again. ``refresh`` puts the
finished buckets of a roll-up's refresh window into a table of its own, for readers that want plain
rows; a later refresh of a bucket replaces the earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.operators.rollups import (
    LATENCIES, STATES, activity_states, daily_of_states, hourly_of_states, latency_states,
    tools_of_states,
)
from sentryspark.sources.batches import Batch, read_table

STATE_TABLES = {"activity_states": (STATES, activity_states), "latency_states": (LATENCIES, latency_states)}
BUCKET_DAY = "bucket_day"

# How far back each roll-up is refreshed, and the newest part it leaves out.
REFRESH_WINDOWS = {
    "agent_activity_hourly": (timedelta(hours=3), timedelta(minutes=5)),
    "agent_activity_daily": (timedelta(days=3), timedelta(hours=1)),
    "tool_usage_hourly": (timedelta(hours=3), timedelta(minutes=5)),
}
# Unit of a roll-up's buckets, and how it is merged from the two state tables.
ROLLUPS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "agent_activity_hourly": ("hour", hourly_of_states),
    "agent_activity_daily": ("day", lambda states, latencies: daily_of_states(states)),
    "tool_usage_hourly": ("hour", lambda states, latencies: tools_of_states(states)),
}
SIZES = {"hour": timedelta(hours=1), "day": timedelta(days=1)}


def add_states(batch: Batch, events: DataFrame) -> None:
    """The states of a batch's events, to be committed with them."""
    for name, (_, build) in STATE_TABLES.items():
        rows = build(events)
        batch.write(name, rows.withColumn(BUCKET_DAY, F.to_date("bucket")), BUCKET_DAY)


def read_states(
    spark: SparkSession, root: str, name: str,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """State rows of the buckets that begin in ``[start, end)``; other days are not opened."""
    schema, _ = STATE_TABLES[name]
    rows = read_table(
        spark, root, name, f"{schema}, {BUCKET_DAY} DATE",
        start.date() if start else None, end.date() if end else None,
    ).drop("source", "batch_id")
    if start is not None:
        rows = rows.where((F.col(BUCKET_DAY) >= F.lit(start.date())) & (F.col("bucket") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col(BUCKET_DAY) <= F.lit(end.date())) & (F.col("bucket") < F.lit(end)))
    return rows.drop(BUCKET_DAY)


def merged(
    spark: SparkSession, root: str, rollup: str,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """A roll-up of all batches so far, for the buckets that begin in ``[start, end)``."""
    _, merge = ROLLUPS[rollup]
    return merge(*[read_states(spark, root, name, start, end) for name in STATE_TABLES])


def refresh_window(rollup: str, as_of: datetime) -> tuple[datetime, datetime]:
    """First bucket of the refresh window at ``as_of`` and the one after its last.

    Buckets count that lie wholly inside the window.
    """
    size = SIZES[ROLLUPS[rollup][0]]
    back, newest = REFRESH_WINDOWS[rollup]
    epoch = datetime(1970, 1, 1)
    first, last = as_of - back, as_of - newest
    return epoch - (epoch - first) // size * size, epoch + (last - epoch) // size * size


def refresh(spark: SparkSession, root: str, rollup: str, as_of: datetime) -> None:
    """Put the finished buckets of the refresh window at ``as_of`` into the roll-up's table."""
    start, end = refresh_window(rollup, as_of)
    rows = merged(spark, root, rollup, start, end)
    batch = Batch(spark, root, f"refresh-{rollup}", int((as_of - datetime(1970, 1, 1)).total_seconds()))
    batch.write(rollup, rows.withColumn(BUCKET_DAY, F.to_date("bucket")), BUCKET_DAY)
    batch.commit()


def read_rollup(
    spark: SparkSession, root: str, rollup: str,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Refreshed rows of the buckets in ``[start, end)``: those of the latest refresh of each."""
    shape = ROLLUPS[rollup][1](*[spark.createDataFrame([], STATE_TABLES[name][0]) for name in STATE_TABLES])
    columns = ", ".join(f"{name} {kind}" for name, kind in shape.dtypes)
    rows = read_table(
        spark, root, rollup, f"{columns}, {BUCKET_DAY} DATE",
        start.date() if start else None, end.date() if end else None).drop("source", BUCKET_DAY)
    if start is not None:
        rows = rows.where(F.col("bucket") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("bucket") < F.lit(end))
    latest = rows.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, ["bucket", "batch_id"], "left_semi").drop("batch_id")
