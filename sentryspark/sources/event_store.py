"""The stored event table: day folders with batches, scan, retention and compaction."""

from __future__ import annotations

from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.schema import EVENTS
from sentryspark.sources.batches import (
    Batch, batch_folders, day_of, file_system, layout, read_table, set_layout, table_folders,
)

DAY = "event_date"
TABLE = "events"

# Days that rows are kept, and the age at which event files are re-laid.
RETENTION_DAYS = {
    "agent_events": 90,
    "agent_activity_hourly": 365,
    "agent_activity_daily": 1095,
    "tool_usage_hourly": 365,
}
COMPACT_AFTER_DAYS = 7
# Parameter: bytes of a compacted file.
FILE_BYTES = 256 << 20


def event_date(column: str = "timestamp"):
    return F.to_date(F.col(column))


def stored_form(events: DataFrame) -> DataFrame:
    """Events in the table's columns; a missing column is filled with NULL.

    Topic position, where the source knows it, is kept; severity hint and SDK name are not
    written by any source.
    """
    spark = events.sparkSession
    shape = spark.createDataFrame([], EVENTS).schema
    defaults = {"properties": F.lit("{}"), "ingested_at": F.current_timestamp()}
    columns = []
    for field in shape:
        default = defaults.get(field.name, F.lit(None))
        value = F.col(field.name) if field.name in events.columns else default
        if field.name in defaults and field.name in events.columns:
            value = F.coalesce(value, default)
        columns.append(value.cast(field.dataType).alias(field.name))
    return events.select(*columns).withColumn(DAY, event_date())


def write_events(events: DataFrame, root: str) -> None:
    """Append events that belong to no micro-batch."""
    write_event_batch(events, None, root, "bulk")


def write_event_batch(
    events: DataFrame, batch_id: int | None, root: str, source: str = "ingest"
) -> None:
    """Write one micro-batch; a replay of the same batch replaces it."""
    batch = Batch(events.sparkSession, root, source, batch_id)
    batch.write(TABLE, stored_form(events), DAY)
    batch.commit()


def read_events(
    spark: SparkSession,
    root: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events of a closed time range; folders of days outside the range are not even listed.

    ``batch_id`` is NULL for events that were appended in bulk or compacted.
    """
    events = read_table(
        spark, root, TABLE, f"{EVENTS}, {DAY} DATE",
        start.date() if start else None, end.date() if end else None).drop("source")
    if start is not None:
        events = events.where((F.col(DAY) >= F.lit(start.date())) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        events = events.where((F.col(DAY) <= F.lit(end.date())) & (F.col("timestamp") <= F.lit(end)))
    return events


def kept_rows(table: DataFrame, column: str, name: str, as_of: datetime) -> DataFrame:
    """Rows of a table that its retention still keeps at ``as_of``."""
    return table.where(F.col(column) >= F.lit(as_of - timedelta(days=RETENTION_DAYS[name])))


def apply_retention(
    spark: SparkSession, root: str, name: str, as_of: datetime, table: str | None = None
) -> list[date]:
    """Drop the days of a table that lie wholly before its retention; returns them.

    Readers leave them out from the moment the layout is replaced; then their folders go, and
    kept files are neither read nor rewritten. ``name`` selects the number of days, ``table`` the
    table, where it has another name.
    """
    table = table or (TABLE if name == "agent_events" else name)
    oldest = (as_of - timedelta(days=RETENTION_DAYS[name])).date()
    expired = table_folders(spark, root, table, last=oldest - timedelta(days=1))
    expired = [folder for folder in expired if day_of(folder)]
    set_layout(spark, root, table, {"oldest": oldest.isoformat()})
    for folder in expired:
        files, where = file_system(spark, folder)
        files.delete(where, True)
    return sorted({day_of(folder) for folder in expired})


def folder_bytes(spark: SparkSession, folder: str) -> int:
    files, where = file_system(spark, folder)
    return files.getContentSummary(where).getLength()


def compact_events(
    spark: SparkSession, root: str, as_of: datetime, file_bytes: int = FILE_BYTES
) -> list[date]:
    """Re-lay days older than a week: by agent and type, newest first; returns the days.

    All folders of a day are merged into one. A day gets a writer per ``file_bytes`` of what it
    holds, rows being dealt by session, so a heavy day is not the work of one task and a light one
    not many small files. Days without new folders since the last time are left alone. Readers see
    the old folders until the layout is replaced, and the new ones from then on.
    """
    before = (as_of - timedelta(days=COMPACT_AFTER_DAYS)).date()
    laid = layout(spark, root, TABLE)
    done = {day_of(folder): folder for folder in laid["folders"]}
    fresh: dict[date, list[str]] = defaultdict(list)
    names = set()
    for name, folder in batch_folders(spark, root, TABLE):
        names.add(name)
        if day_of(folder) < before:
            fresh[day_of(folder)].append(folder)
    if not fresh:
        return []
    merged = {day: [*folders, *filter(None, [done.get(day)])] for day, folders in fresh.items()}
    writers = {day: max(1, -(-sum(folder_bytes(spark, f) for f in folders) // file_bytes))
               for day, folders in merged.items()}
    rows = spark.read.schema(f"{EVENTS}, {DAY} DATE").option("basePath", f"{root}/{TABLE}").parquet(
        *[folder for folders in merged.values() for folder in folders]).drop("try", "source", "batch_id")
    fan = F.create_map(*[F.lit(v) for pair in writers.items() for v in pair])[F.col(DAY)]
    spread = F.pmod(F.xxhash64("session_id", "event_id"), fan)
    batch = Batch(spark, root, "compact")
    batch.write(TABLE, rows.repartition(sum(writers.values()), F.col(DAY), spread)
                .sortWithinPartitions(DAY, "agent_id", "event_type", F.desc("timestamp")), DAY)
    done |= {day_of(folder): folder for folder in batch.tables[TABLE]}
    set_layout(spark, root, TABLE, {
        "folders": list(done.values()), "before": before.isoformat(),
        "covered": sorted({*laid["covered"], *names})})
    return sorted(fresh)
