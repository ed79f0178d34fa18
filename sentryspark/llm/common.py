"""What the operators of this subpackage share: registry, tables, shared folders, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentryspark.session import new_folder, written  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# White space that separates words: ASCII space and \t \n \v \f \r.
SPACES = "\\x20\\x09-\\x0D"
WORD_GAP = f"[{SPACES}]+"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can state the result."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach, below ``spark.checkpoint.dir`` where that is set."""
    return new_folder(spark, name)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(0))


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str | T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
) -> DataFrame:
    """Run ``make()`` once per task and its result on every Arrow batch of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.select(*columns).mapInArrow(run, schema)
