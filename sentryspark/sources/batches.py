"""Tables written batch by batch, which readers follow through commits.

A micro-batch writes its rows of every table to folders of its own and then names all of them in
one commit file, which a rename puts in place. Readers start from the commits: they see all tables of
a batch or none of them, and a replayed batch takes the place of its first try whatever its rows.

Tables with a day column have one folder per day below; commits name those, so that a read of some
days opens no other folder. A table may have a layout, one file that a rename replaces: folders that
stand in for the old days of the batches it covers (compaction), and the oldest day that is read
(retention). Folders that no commit and no layout names are garbage for ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS, LAYOUTS = "commits", "layouts"
# What Spark reads as NULL in a folder name: rows of no micro-batch.
NO_BATCH = "__HIVE_DEFAULT_PARTITION__"
DAY_FOLDER = re.compile(r"=(\d{4}-\d\d-\d\d)[^/]*$")
COMMIT = "name STRING, source STRING, batch_id BIGINT, tables MAP<STRING, ARRAY<STRING>>"
BATCH_COLUMNS = "source STRING, batch_id BIGINT"


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    files, where = file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(where)]


def replace_file(spark: SparkSession, path: str, content: dict) -> None:
    """Put a small JSON file in place at once, over the one that is there."""
    folder, _, name = path.rpartition("/")
    # Readers skip names that start with a point.
    files, draft = file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    place = fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration())
    place.rename(draft, fs.Path(path), options)


class Batch:
    """The tables of one batch of one source, visible from ``commit`` on."""

    def __init__(self, spark: SparkSession, root: str, source: str, batch_id: int | None = None):
        self.spark, self.root, self.source, self.batch_id = spark, root, source, batch_id
        self.mark = uuid.uuid4().hex
        self.name = f"{source}-{self.mark if batch_id is None else f'{batch_id:012d}'}"
        self.tables: dict[str, list[str]] = {}

    def write(self, table: str, rows: DataFrame, day: str | None = None) -> DataFrame:
        """Write a table's rows and return them as read back; ``day`` names the day column."""
        batch = NO_BATCH if self.batch_id is None else self.batch_id
        folder = f"{self.root}/{table}/source={self.source}/batch_id={batch}/try={self.mark}"
        writer = rows.write.partitionBy(day) if day else rows.write
        writer.parquet(folder)
        self.tables[table] = [folder] if day is None else [
            f"{folder}/{name}" for name in children(self.spark, folder) if name.startswith(f"{day}=")]
        return self.spark.read.schema(rows.schema).parquet(folder)

    def commit(self) -> None:
        replace_file(self.spark, f"{self.root}/{COMMITS}/{self.name}.json", {
            "name": self.name, "source": self.source, "batch_id": self.batch_id,
            "tables": self.tables})


def commits(spark: SparkSession, root: str) -> list[T.Row]:
    """One row per committed batch, read by Spark as there may be many."""
    if not exists(spark, f"{root}/{COMMITS}"):
        return []
    return spark.read.schema(COMMIT).json(f"{root}/{COMMITS}").collect()


def layout(spark: SparkSession, root: str, table: str) -> dict:
    """Folders that stand in for the days before ``before`` of the ``covered`` batches."""
    path = f"{root}/{LAYOUTS}/{table}.json"
    found = {"folders": [], "before": None, "covered": [], "oldest": None}
    if exists(spark, path):
        found |= json.loads(spark.read.text(path, wholetext=True).first()[0])
    return found


def set_layout(spark: SparkSession, root: str, table: str, changed: dict) -> None:
    replace_file(spark, f"{root}/{LAYOUTS}/{table}.json", layout(spark, root, table) | changed)


def day_of(folder: str) -> date | None:
    found = DAY_FOLDER.search(folder)
    return date.fromisoformat(found[1]) if found else None


def batch_folders(spark: SparkSession, root: str, table: str) -> Iterator[tuple[str, str]]:
    """(batch name, folder) of a table as its batches wrote them, but for what a layout covers."""
    laid = layout(spark, root, table)
    covered, before = set(laid["covered"]), laid["before"]
    for row in commits(spark, root):
        for folder in row.tables.get(table, []):
            day = day_of(folder)
            if not (before and row["name"] in covered and day and day.isoformat() < before):
                yield row["name"], folder


def table_folders(
    spark: SparkSession, root: str, table: str, first: date | None = None, last: date | None = None,
) -> list[str]:
    """Folders that make up a table, without those of days outside the range."""
    laid = layout(spark, root, table)
    oldest = date.fromisoformat(laid["oldest"]) if laid["oldest"] else None
    since = max(filter(None, (first, oldest)), default=None)
    found = [*laid["folders"], *(folder for _, folder in batch_folders(spark, root, table))]
    return [folder for folder in found if (day := day_of(folder)) is None or (
        (since is None or day >= since) and (last is None or day <= last))]


def read_table(
    spark: SparkSession, root: str, table: str, schema: str,
    first: date | None = None, last: date | None = None,
) -> DataFrame:
    """Committed rows of a table, with ``source`` and ``batch_id`` (NULL outside micro-batches)."""
    wanted = f"{schema}, {BATCH_COLUMNS}"
    folders = table_folders(spark, root, table, first, last)
    if not folders:
        return spark.createDataFrame([], wanted)
    reader = spark.read.schema(wanted).option("basePath", f"{root}/{table}")
    return reader.parquet(*folders).drop("try")


def vacuum(spark: SparkSession, root: str, table: str) -> list[str]:
    """Delete the tries of a table that nothing names any more; call it while no batch is open."""
    files, _ = file_system(spark, root)
    kept = {folder for _, folder in batch_folders(spark, root, table)}
    kept |= set(layout(spark, root, table)["folders"])
    gone = []
    base = f"{root}/{table}"
    for source in children(spark, base):
        for batch in children(spark, f"{base}/{source}"):
            for attempt in children(spark, f"{base}/{source}/{batch}"):
                folder = f"{base}/{source}/{batch}/{attempt}"
                days = [f"{folder}/{name}" for name in children(spark, folder) if day_of(f"{folder}/{name}")]
                unused = [day for day in days if day not in kept]
                if folder not in kept and len(unused) == len(days):
                    unused = [folder]
                elif folder in kept:
                    unused = []
                for path in unused:
                    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
                gone += unused
    return gone
