"""Session settings the library relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Open records of the folders that are being made; see ``scratch``.
_RECORDS: list[list[str]] = []

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes: UTC time and adaptive plans."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A message may repeat a field name; the last one counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """``prepare`` plus the state store that ``transformWithState`` needs."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``.

    A local session may do without the setting and has a folder below its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` where it feeds several later steps, so that it is computed once."""
    return written(df, "cut")


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders made by ``new_folder`` meanwhile."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        # By identity: records of nested scopes can be equal.
        _RECORDS[:] = [other for other in _RECORDS if other is not record]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside; for work whose results are written inside."""
    with recorded() as folders:
        try:
            yield
        finally:
            for folder in folders:
                delete_folder(spark, folder)
