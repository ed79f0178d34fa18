"""Token ids as Parquet lists, for selective reads.

A file holds one row per document in ascending ``doc_id``: ``doc_id``, ``block`` (number of its
file in that order), ``start_in_block``, ``n_tokens`` and ``ids``, a list of 32-bit integers. Ids
are dictionary-encoded (a vocabulary has few distinct values in a row group); the metadata columns
are not and so get delta encoding. Row groups and pages have set sizes and pages have an index, so
a read of some documents or of the metadata alone touches only their pages.

Null texts are empty; an empty text is its end id alone. Null ids come first. Documents with an
equal id are ordered by their text, repeated rows share neither tokens nor place. An empty table gives
no row. A long text is one list; lists go to batches of bounded size. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import map_texts, query, shared_folder, table
from sentryspark.llm.tokens import encoder, slices, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
# Parameters of the files. There are as many as shuffle partitions, or more where the texts are larger than
# so many times INPUT_BYTES.
INPUT_BYTES = 256 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

FILE_SCHEMA = "doc_id long, block int, start_in_block long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def make():
        words = encoder(path, False)
        end = end_id.to_bytes(4, "little")
        state = {"block": None, "start": 0}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = batch.column(2)[0].as_py()
            texts = [text or "" for text in batch.column(1).to_pylist()]
            parts = [ids for low, high in slices(texts) for ids in words.encode(texts[low:high])]
            sizes = np.array([len(ids) // 4 + 1 for ids in parts], dtype=np.int64)
            if state["block"] != block:
                state["block"], state["start"] = block, 0
            ends = state["start"] + np.cumsum(sizes)
            starts = ends - sizes
            state["start"] = int(ends[-1])
            values = np.frombuffer(b"".join([ids + end for ids in parts]), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(starts),
                 pa.array(sizes), lists],
                ["doc_id", "block", "start_in_block", "n_tokens", "ids"])

        return step

    return make


def write_tokens(documents: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write them to ``folder`` in ascending ``doc_id``.

    Files are ranges of (doc_id, text hash, row): a repeated id may span files, so that one id
    with a third of all rows is no single task.
    """
    spark = documents.sparkSession
    rows = documents.select(
        "doc_id", "text", F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_BYTES))
    ranged = (
        rows.repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("block"))
    )
    encoded = map_texts(ranged, ["doc_id", "text", "block"], FILE_SCHEMA, _encode(path, end_id))
    (
        encoded.write
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files, with ``start``: ids of all documents before.

    The blocks' totals come from the metadata columns; there is one per file, which bounds the
    window over them and the broadcast.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = rows.groupBy("block").agg(F.sum("n_tokens").alias("tokens"))
    starts = totals.selectExpr(
        "block", "sum(tokens) OVER (ORDER BY block) - tokens AS block_start")
    return rows.join(F.broadcast(starts), "block").select(
        "doc_id", (F.col("block_start") + F.col("start_in_block")).alias("start"), "n_tokens",
        "ids")


def _checksums():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy() * 4
        raw = lists.values.cast(pa.int32()).to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return step


def checksums(tokens: DataFrame) -> DataFrame:
    return map_texts(tokens, ["doc_id", "start", "n_tokens", "ids"],
                     "doc_id long, start long, n_tokens long, ids_crc32 long", _checksums)


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(VOCABULARY))
    return checksums(read_tokens(spark, folder))
