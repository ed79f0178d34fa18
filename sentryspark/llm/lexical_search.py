"""Ranked lexical search: every item of a query table against all documents, exact top-k.

Documents are read once: each gives its number of terms and the frequencies of the items' terms in
it. Totals and document frequencies follow from that table. It is then read in blocks: per item,
the block's documents are grouped by presence mask, one bit per term of the item, set by bitmap
operations from the block's postings. A mask's maximum is the sum of its terms' largest impacts in
the block, so distinct masks are evaluated in descending order of it until the next maximum is
below the k-th best score found by the task: no better document can be left.

The items' vocabulary goes to every task. It is bounded: items are dealt to blocks of
``ITEM_CHARACTERS`` in all (one more item at most), and each block of items is a search of its own
over all documents. A task keeps at most k rows per item; these alone are shuffled.

Null and empty texts have no terms, are in no count and never found; items without terms find
nothing. Each row is a document, each row of the items an item of its own, repeated ones too. Equal
scores go by ascending ``doc_id``, null last; rows equal in both are interchangeable. Empty tables
give no row. A long text is held as one list of words. Other columns are ignored. Scores are 64-bit
integers throughout.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentryspark.llm.byte_words import words_of
from sentryspark.llm.common import query, table, written
from sentryspark.llm.ordered import in_order
from sentryspark.llm.resampling import WORDS_SQL

# Parameters.
TOP = 50
ITEM_CHARACTERS = 2_000_000
FIRST_MASKS = 64  # distinct masks in the first step of an evaluation; doubled from step to step

FOUND = "item long, doc_id long, score long"


def frequencies(documents: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms, repeats counted) and the vocabulary's ``terms`` with ``tf``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, offsets, terms, tf = [], [0], [], []
            for raw in batch.column(1):
                words = words_of(raw.as_py())
                sizes.append(len(words))
                counts = Counter(words)
                held = sorted((places[word], counts[word]) for word in counts.keys() & places.keys())
                terms.extend(term for term, _ in held)
                tf.extend(n for _, n in held)
                offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                ["doc_id", "n", "terms", "tf"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Block:
    """Postings of a block of documents, by term, with every posting's impact."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, terms: int):
        lists, flat_tf = batch.column(2), batch.column(3).flatten()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = flat_tf.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        self.size = batch.num_rows
        doc = np.repeat(np.arange(self.size), lengths)
        norm = np.array([50 + 50 * n * documents // terms for n in batch.column(1).to_pylist()], np.int64)
        impact = weights[flat] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[doc]))
        by_term = np.argsort(flat, kind="stable")
        self.doc, self.impact, sorted_terms = doc[by_term], impact[by_term], flat[by_term]
        seen, starts = np.unique(sorted_terms, return_index=True)
        ends = np.append(starts[1:], len(sorted_terms))
        self.span = {int(t): (int(a), int(b)) for t, a, b in zip(seen, starts, ends)}
        self.most = dict(zip(map(int, seen), np.maximum.reduceat(self.impact, starts))) if len(seen) else {}

    def masks(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a term, and their masks: 64 terms to a column."""
        masks = np.zeros((self.size, (len(terms) + 63) // 64), np.uint64)
        for place, term in enumerate(terms):
            low, high = self.span[term]
            masks[self.doc[low:high], place >> 6] |= np.uint64(1 << (place & 63))
        touched = np.flatnonzero(masks.any(axis=1))
        return touched, masks[touched]

    def scores(self, docs: np.ndarray, terms: list[int]) -> np.ndarray:
        """Exact scores of ascending documents."""
        total = np.zeros(len(docs), np.int64)
        for term in terms:
            low, high = self.span[term]
            holders = self.doc[low:high]
            at = np.searchsorted(holders, docs)
            at[at == len(holders)] = 0
            hit = holders[at] == docs
            total[hit] += self.impact[low:high][at[hit]]
        return total


def distinct_masks(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks, and for each row the number of its mask."""
    if masks.shape[1] == 1:
        values, number = np.unique(masks[:, 0], return_inverse=True)
        return values[:, None], number
    values, number = np.unique(masks, axis=0, return_inverse=True)
    return values, number.reshape(-1)


class Best:
    """The k best documents of an item so far; a null id has its own flag and sorts last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def floor(self) -> int:
        """Scores below this can't enter; 1 until k documents are held."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        enough = score >= self.floor()
        score = np.concatenate([self.score, score[enough]])
        doc_id = np.concatenate([self.doc_id, doc_id[enough]])
        no_id = np.concatenate([self.no_id, no_id[enough]])
        order = np.lexsort((doc_id, no_id, -score))[:self.top]
        self.score, self.doc_id, self.no_id = score[order], doc_id[order], no_id[order]


def evaluate(block: Block, terms: list[int], ids: np.ndarray, no_id: np.ndarray, best: Best) -> int:
    """Add an item's documents of a block to its best ones; the number of masks evaluated."""
    terms = [term for term in terms if block.most.get(term, 0) > 0]
    if not terms or sum(int(block.most[term]) for term in terms) < best.floor():
        return 0
    docs, masks = block.masks(terms)
    values, number = distinct_masks(masks)
    maximum = np.zeros(len(values), np.int64)
    for place, term in enumerate(terms):
        held = values[:, place >> 6] >> np.uint64(place & 63) & np.uint64(1)
        maximum += held.astype(np.int64) * block.most[term]
    order = np.argsort(-maximum, kind="stable")
    members = np.argsort(number, kind="stable")
    first = np.searchsorted(number[members], np.arange(len(values) + 1))
    done, step = 0, FIRST_MASKS
    while done < len(order) and maximum[order[done]] >= best.floor():
        chosen = order[done:done + step]
        chosen = chosen[maximum[chosen] >= best.floor()]
        group = np.sort(docs[np.concatenate([members[first[m]:first[m + 1]] for m in chosen])])
        best.add(block.scores(group, terms), ids[group], no_id[group])
        done, step = done + len(chosen), step * 2
    return done


def _best_of_task(items: list[tuple[int, list[int]]], weights: list[int], documents: int, terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array(weights, np.int64)
        best = {number: Best(top) for number, _ in items}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch, weight, documents, terms)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for number, held in items:
                evaluate(block, held, ids, no_id, best[number])
        sizes = [len(best[number].score) for number, _ in items]
        if not sum(sizes):
            return
        column = {name: np.concatenate([getattr(best[number], name) for number, _ in items])
                  for name in ("score", "doc_id", "no_id")}
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([number for number, _ in items], sizes)),
             pa.array(column["doc_id"], mask=column["no_id"]), pa.array(column["score"])],
            ["item", "doc_id", "score"])

    return run


def term_weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log(float(2 * documents + 2) / float(2 * holders + 1)))


def _search_block(documents: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """The best documents of one block of items: ``item``, ``rank``, ``doc_id``, ``score``."""
    vocabulary = sorted({word for _, words in items for word in words})
    places = {word: place for place, word in enumerate(vocabulary)}
    rows = written(frequencies(documents, places), "frequencies")
    n_documents, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = dict(map(tuple, rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
    weights = [term_weight(n_documents, holders.get(place, 0)) for place in range(len(vocabulary))]
    asked = [(number, [places[word] for word in words]) for number, words in items]
    best = _best_of_task(asked, weights, n_documents, max(n_terms, 1), top)
    found = rows.mapInArrow(best, FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(documents: DataFrame, items: DataFrame, top: int = TOP,
           item_characters: int = ITEM_CHARACTERS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``top`` best documents of each item."""
    spark = documents.sparkSession
    sized = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "items")
    placed = written(
        in_order(sized, [F.col("item.item_id").asc_nulls_last()], F.length("item.text")).select(
            "item.item_id", "item.text", F.col("place").alias("item"),
            F.expr(f"before div {item_characters}").alias("block")), "item-blocks")
    results = []
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        texts = placed.where(F.col("block") == block).select("item", "text").collect()
        asked = [(row["item"], sorted(set(words_of(row["text"].encode())))) for row in texts]
        results.append(_search_block(documents, sorted(asked), top))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionAll, results)
    named = placed.select("item", "item_id")
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = WORDS_SQL.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS terms FROM documents),
totals AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM docs WHERE len(terms) > 0),
tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY ALL
), items AS (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT DISTINCT item, unnest(terms) AS term FROM items),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY term
), norms AS (
  SELECT doc_id, row, 50 + (50 * len(d.terms) * t.docs) // t.terms AS m FROM docs d, totals t
), scores AS (
  SELECT item, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (row) GROUP BY item, row
), ranked AS (
  SELECT item, row, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scores JOIN norms USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) JOIN norms USING (row) WHERE rank <= 50
"""


@query("op12_lexical_search", SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
