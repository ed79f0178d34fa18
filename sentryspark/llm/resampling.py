"""Resampling by importance: documents whose words look like those of a target are drawn more often.

Words and runs of words are hashed to a fixed number of buckets. A bucket's gain is the scaled
logarithm of its smoothed share in the target over its share in the documents; a document's weight
is the floored mean gain of its features. Adding Gumbel noise that depends on seed and id alone
and taking the highest scores draws without replacement in proportion to exp(weight / 1000), and
a rerun draws the same documents.

The documents' texts are read twice, for the counts and for the weights, as their features take
more room than the texts. Bucket counts are the only thing the driver holds: one row per bucket.
The cut comes from a histogram of the scores, integers in a range that the logarithms bound.

Null and empty texts, and those without a word, have no features, weight 0 and are never drawn when
``least_words`` is 1 or more. A null id counts as empty text in the noise and loses ties. Ties go to
smaller ids, then to fewer features; rows equal in both are interchangeable. Repeated rows are
documents of their own. An empty target has no counts, which leaves the smoothing; an empty
documents table gives no row. Long texts are held one at a time as lists of words. Other columns of
any name are ignored by ``resample`` and kept by ``drawn``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.byte_words import Checksums, run_checksums, words_of
from sentryspark.llm.common import query, table, written
from sentryspark.llm.ordered import in_order

# Parameters.
LONGEST_RUN = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000

SCORES = "doc_id long, n_words long, n_features long, weight long, score long"


def count_buckets(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: features of all texts, repeats counted, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Checksums(), np.zeros(buckets, np.int64)
        for batch in batches:
            found: Counter = Counter()
            for raw in batch.column(0):
                found.update(run_checksums(words_of(raw.as_py()), longest, known))
            keys = np.fromiter(found.keys(), np.int64, len(found)) % buckets
            np.add.at(counts, keys, np.fromiter(found.values(), np.int64, len(found)))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, longest: int = LONGEST_RUN,
                 buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket; two rows of counts per bucket reach the driver."""
    held, sought = [0] * buckets, [0] * buckets
    for counts, texts in ((held, documents), (sought, target)):
        for bucket, n in count_buckets(texts, longest, buckets).collect():
            counts[bucket] = n
    all_held, all_sought = sum(held), sum(sought)
    return [
        math.floor(SCALE * math.log(float(t + 1) * float(all_held + buckets)
                                    / (float(s + 1) * float(all_sought + buckets))))
        for s, t in zip(held, sought)
    ]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise, scaled, of a document."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int.from_bytes(hashlib.sha256(key).digest()[:4], "big")
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def score(documents: DataFrame, gains: list[int], longest: int = LONGEST_RUN, seed: int = SEED,
          keep_row: bool = False) -> DataFrame:
    """Words, features, weight and score of every row; ``keep_row`` adds its columns as ``item``."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = Checksums(), np.array(gains, np.int64)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            rows = []
            for doc_id, raw in zip(ids.to_pylist(), batch.column(1)):
                words = words_of(raw.as_py())
                found = run_checksums(words, longest, known)
                weight = 0
                if found:
                    keys = np.fromiter(found, np.int64, len(found)) % buckets
                    weight = int(gain[keys].sum()) // len(found)
                rows.append((len(words), len(found), weight, weight + noise(doc_id, seed)))
            sizes = [pa.array(column, pa.int64()) for column in zip(*rows)] or [pa.array([], pa.int64())] * 4
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            more = [batch.column(2)] if keep_row else []
            yield pa.RecordBatch.from_arrays([ids, *sizes, *more], names + ["item"][:len(more)])

    row = F.struct("*").alias("item")
    fields = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")]
    if not keep_row:
        return documents.select(*fields).mapInArrow(run, SCORES)
    carried = documents.select(*fields, row)
    schema = documents.sparkSession.createDataFrame([], SCORES).schema.add(carried.schema["item"])
    return carried.mapInArrow(run, schema)


def _order(prefix: str = "item.") -> list[Column]:
    return [F.col(prefix + "score").desc(), F.col(prefix + "doc_id").asc_nulls_last(),
            F.col(prefix + "n_features").asc()]


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (a written table) with ``rank``: place among the drawn, null for the others.

    The histogram of scores has at most some 100,000 rows, as gains and noise are logarithms of
    64-bit counts and of 32-bit hashes. Only rows from the cut's score on are sorted.
    """
    fit = F.col("n_words") >= least_words
    histogram = scored.where(fit).groupBy("score").count().collect()
    left = sum(row["count"] for row in histogram) * percent // 100
    drawn, cut = left, None
    for value, n in sorted(map(tuple, histogram), reverse=True):
        if left <= 0:
            break
        cut, left = value, left - n
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = fit & (F.col("score") >= cut)
    placed = in_order(scored.where(above), _order()).select(
        *[f"item.{name}" for name in columns],
        F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    rest = scored.where(~above).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.unionAll(rest)


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST_RUN,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document."""
    gains = bucket_gains(documents, target, longest, buckets)
    return ranked(written(score(documents, gains, longest, seed), "scores"), least_words, percent)


def drawn(documents: DataFrame, target: DataFrame, longest: int = LONGEST_RUN,
          buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
          seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns, in no order.

    Rows equal to the last drawn one in score, id and features are all drawn or not with it, so
    repeated rows can make a few more than ``percent``.
    """
    gains = bucket_gains(documents, target, longest, buckets)
    scored = score(documents, gains, longest, seed, keep_row=True)
    plan = ranked(written(scored.drop("item"), "scores"), least_words, percent)
    last = plan.where("rank IS NOT NULL").agg(
        F.max(F.struct(F.col("rank"), F.col("score"), F.col("doc_id"), F.col("n_features"))).alias("last")).first().last
    if last is None:
        return documents.where("false")
    ahead = (F.col("score") > last.score)
    no_id, ids = F.col("doc_id").isNull(), F.col("doc_id")
    if last.doc_id is None:
        tied = ~no_id | (F.col("n_features") <= last.n_features)
    else:
        tied = ~no_id & ((ids < last.doc_id) | ((ids == last.doc_id) & (F.col("n_features") <= last.n_features)))
    kept = (F.col("n_words") >= least_words) & (ahead | ((F.col("score") == last.score) & tied))
    return scored.where(kept).select("item.*")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH steps AS (
  SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda crc, k:
    CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM range(256) t(byte)
), crc_table AS (SELECT list(crc ORDER BY byte) AS crcs FROM steps),
words AS (
  SELECT 'd' AS side, doc_id, rowid AS row, unnest({WORDS_SQL}) AS word
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
  UNION ALL
  SELECT 'b', NULL, NULL, unnest({WORDS_SQL}) FROM benchmark
), vocabulary AS (
  SELECT word, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(strlen(word)), lambda i:
        ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
      lambda crc, byte: xor(crc >> 8, crcs[xor(crc & 255, byte) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM words JOIN vocabulary USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN vocabulary USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), noisy AS (
  SELECT doc_id, row_number() OVER () AS row,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM noisy LEFT JOIN weights USING (row)
), fit AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
    PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM fit
"""


@query("op11_importance_resampling", SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return plan.select("doc_id", "n_features", "weight", "score", "rank")
