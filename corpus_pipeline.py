"""The documents of a training corpus, stage by stage.

Each stage takes what the one before kept, as Parquet, and all but the last return the columns of
``documents``: texts of poor quality go, one of each group of near-duplicates stays, documents with a
benchmark item go, personal data is replaced by its kind, and what remains is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sentryspark.llm.common import query, table
from sentryspark.llm.decontamination import without_leaks
from sentryspark.llm.packing import VOCABULARY, pack_documents
from sentryspark.llm.personal_data import redact
from sentryspark.llm.quality import keep_good
from sentryspark.llm.simhash import keep_one
from sentryspark.llm.tokens import tokenizer_path
from sentryspark.session import delete_folder, new_folder, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Intermediate tables of the stage that ran last, and that stage. Its result needs them until it
# is written; then the next stage is given the written table.
_LEFT: list[str] = []
_LAST: list[str] = []


def stage(build: Stage) -> Stage:
    """A stage that first deletes what the stage before it in ``STAGES`` needed.

    Nothing is deleted while ``docs`` still reads it, or where stages are called in another order.
    """

    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [name for name, _ in STAGES]
        place = names.index(build.__name__)
        if place and _LAST == [names[place - 1]]:
            read = docs.inputFiles()
            for folder in _LEFT:
                if not any(folder.rsplit("/", 1)[1] in path for path in read):
                    delete_folder(spark, folder)
        with recorded() as folders:
            result = build(spark, docs, sf_dir)
        _LEFT[:], _LAST[:] = folders, [build.__name__]
        return result

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Trained models and tokenizers have no SQL form: tests/llm follows the rows through all stages.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        result = build(spark, docs, sf_dir)
        result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
    return docs
