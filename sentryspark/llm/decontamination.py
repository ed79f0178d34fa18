"""Benchmark decontamination: item-sized windows compared by SimHash, then exactly.

Texts are word shingles (five words; an item below five words is one shingle). A window has as many
shingles as the item (a shorter document is one window). A window at the required similarity must hold
most shingles of the item, and moving its start to its first such shingle only adds to them,
so windows are taken at shingles that occur in an item and where a fair part (``ANCHORED``) of the
item's shingles follows. No window above the threshold is lost by this; which item a window may be, and
whether it is near, is left to the fingerprints. The pass that hashes the shingles also cuts the
windows out, so the texts are read once and never shuffled.

Distinct windows get a SimHash. Blocks of bits find every item fingerprint within ``RADIUS`` bits:
by the generalised pigeonhole principle the thresholds of the blocks need only add up to
``RADIUS - BLOCKS + 1``, so items are listed in each block under all values within its threshold,
and a window looks up its own four values. Wide blocks prune: an unrelated fingerprint meets an item
in some block with a chance of 4 %. Candidates within the radius are verified by the weighted Jaccard
similarity of the shingle multisets. At similarity 0.8 fingerprints differ by 10 bits on average
(standard deviation 3); the tests measure the recall of planted windows.

Null texts, empty texts and empty items match nothing. Empty tables give no row. Rows of equal doc_id and
text give one result; rows of equal item_id and text too. Of several windows of a document the most
similar counts, then the first. A long text is one array of hashes in one task. Other columns are
ignored by ``find_leaks`` and kept by ``without_leaks``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import WORD_GAP, query, table, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
# Parameters: share of an item's shingles that makes a window worth a fingerprint, and shingles of
# items broadcast at once; more items are taken in several passes.
ANCHORED = 0.25
BROADCAST_SHINGLES = 200_000


def words_of(text: str) -> str:
    gap = WORD_GAP.replace("\\", "\\\\")
    return f"filter(split(lower(coalesce({text}, '')), '{gap}'), word -> word <> '')"


def shingles_of(words: str, size: str) -> str:
    """SQL for the hashes of all runs of ``size`` words; the words are computed once."""
    return (
        f"transform(array({words}), w -> CASE WHEN size(w) >= {size} THEN "
        f"transform(sequence(0, size(w) - {size}), i -> xxhash64(slice(w, i + 1, {size}))) "
        f"ELSE array() END)[0]"
    )


def fingerprint(hashes: str) -> str:
    """SQL for the SimHash of an array of hashes: majority of each bit."""
    return (
        f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | IF("
        f"aggregate({hashes}, 0, (n, h) -> n + CAST(shiftrightunsigned(h, b) & 1L AS INT)) * 2 "
        f"> size({hashes}), shiftleft(1L, b), 0L))"
    )


def as_set(hashes: str) -> str:
    """SQL that turns a multiset into a set: the n-th copy of a hash becomes another hash."""
    copies = f"size(filter(slice({hashes}, 1, i), y -> y = h))"
    return (
        f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN {hashes} ELSE "
        f"transform({hashes}, (h, i) -> IF(i = 0 OR {copies} = 0, h, xxhash64(h, {copies}))) END"
    )


def block_value(column: str, block: int) -> str:
    return f"CAST(shiftrightunsigned({column}, {block * BLOCK_BITS}) & {2 ** BLOCK_BITS - 1} AS INT)"


def thresholds(radius: int) -> list[int]:
    """Bits by which a block may differ; -1: the block need not be looked up.

    If every block differed by more than its threshold, the whole would differ by at least the
    thresholds' sum and one more for every block, which is beyond the radius.
    """
    total = radius - BLOCKS + 1
    return [(total + BLOCKS - 1 - block) // BLOCKS if total >= 0 else (0 if block <= radius else -1)
            for block in range(BLOCKS)]


def block_entries(column: str, limits: list[int], near: bool) -> Column:
    """(block, value) pairs: the fingerprint's own values, or all within the blocks' thresholds."""
    listed = []
    for block, limit in enumerate(limits):
        if limit >= 0:
            masks = [sum(1 << bit for bit in flips) for size in range(limit + 1 if near else 1)
                     for flips in combinations(range(BLOCK_BITS), size)]
            listed.append(
                f"transform(array({', '.join(map(str, masks))}), m -> "
                f"struct({block} AS block, {block_value(column, block)} ^ m AS value))")
    return F.expr(f"flatten(array({', '.join(listed)}))")


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, size, shingle, grams): words, words of a shingle, and shingle hashes of items."""
    return (
        items.selectExpr("item_id", f"{words_of('text')} AS words")
        .where("size(words) > 0")
        .selectExpr("item_id", "size(words) AS size", f"least(size(words), {SHINGLE}) AS shingle",
                    "words")
        .selectExpr("item_id", "size", "shingle",
                    f"{shingles_of('words', 'least(size(w), ' + str(SHINGLE) + ')')} AS grams")
    )


def find_windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, size, shingle, start, grams): windows with a fair part of an item."""
    grams = items.selectExpr(
        "item_id", "size", "shingle", "size(grams) AS length", "explode(grams) AS gram").distinct()
    passes = -(-grams.count() // BROADCAST_SHINGLES) or 1
    sizes = [row.shingle for row in items.select("shingle").distinct().orderBy("shingle").collect()]
    if not sizes:
        return documents.selectExpr(
            "doc_id", "0L AS text_hash", "0 AS size", "0 AS shingle", "0 AS start",
            "array(0L) AS grams").where("false")
    of_size = ", ".join(
        f"struct({size} AS shingle, {shingles_of('w', str(size))} AS grams)" for size in sizes)
    spread = (
        documents.selectExpr("doc_id", "xxhash64(text) AS text_hash",
                             f"inline(transform(array({words_of('text')}), w -> array({of_size}))[0])")
        .selectExpr("*", "size(grams) AS held", "posexplode(grams) AS (place, gram)")
    )
    hits = None
    for number in range(passes):
        part = grams.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        found = spread.join(F.broadcast(part), ["shingle", "gram"]).selectExpr(
            "doc_id", "text_hash", "item_id", "size", "shingle", "place",
            "least(length, held) AS width", "least(place, held - least(length, held)) AS start",
            "slice(grams, least(place, held - least(length, held)) + 1, least(length, held)) AS grams")
        hits = found if hits is None else hits.union(found)
    # Repeated rows hit alike.
    keys = ["doc_id", "text_hash", "item_id", "place"]
    hits = hits.groupBy(*keys).agg(*[F.first(name).alias(name) for name in
                                     ("size", "shingle", "width", "start", "grams")])
    order = "PARTITION BY doc_id, text_hash, item_id ORDER BY place"
    # The frame is wide enough for all windows of a place; its own length counts.
    longest = items.agg(F.max(F.size("grams"))).head()[0]
    frame = f"RANGE BETWEEN CURRENT ROW AND {longest - 1} FOLLOWING"
    return (
        hits.selectExpr("*", f"collect_list(place) OVER ({order} {frame}) AS ahead")
        .where(f"size(filter(ahead, p -> p < place + width)) >= {ANCHORED} * width")
        .select("doc_id", "text_hash", "size", "shingle", "start", "grams")
        .distinct()
    )


def near_items(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct windows with the items of their size whose fingerprints lie within ``radius``."""
    limits = thresholds(radius)
    prints = windows.select("size", "shingle", "grams").distinct().selectExpr(
        "*", f"{fingerprint('grams')} AS print")
    own = items.selectExpr("item", "size", "shingle", f"{fingerprint('grams')} AS item_print")
    near = own.withColumn("entry", F.explode(block_entries("item_print", limits, True)))
    probe = prints.withColumn("entry", F.explode(block_entries("print", limits, False)))
    found = (
        probe.join(near, ["size", "shingle", "entry"])
        .where(F.expr(f"bit_count(print ^ item_print) <= {radius}"))
        .selectExpr("size", "shingle", "grams", "item",
                    "CAST(bit_count(print ^ item_print) AS INT) AS distance")
        .distinct()
    )
    return found.join(items.selectExpr("item", "item_id", "grams AS item_grams"), "item")


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance and similarity of every leaked item."""
    items = written(
        item_table(benchmark).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    windows = written(find_windows(documents.select("doc_id", "text"), items), "windows")
    matched = (
        near_items(windows, items, radius)
        .selectExpr("*", f"size(array_intersect({as_set('grams')}, {as_set('item_grams')})) AS common")
        .selectExpr("size", "shingle", "grams", "item_id", "distance",
                    "common / (size(grams) + size(item_grams) - common) AS similarity")
        .where(F.col("similarity") >= similarity - 1e-9)
    )
    best = F.max_by(
        F.struct("start", "size", "distance", "similarity"),
        F.struct("similarity", -F.col("start")))
    return (
        windows.join(matched, ["size", "shingle", "grams"])
        .groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
        .selectExpr("doc_id", "text_hash", "item_id", "best.start AS start",
                    "best.size AS n_words", "best.distance AS distance",
                    "best.similarity AS similarity")
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    leaks = written(find_leaks(documents, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    rows = documents.select(
        F.struct("*").alias("item"), "doc_id", F.xxhash64("text").alias("text_hash"))
    found = rows["doc_id"].eqNullSafe(leaks["doc_id"]) & (rows["text_hash"] == leaks["text_hash"])
    return rows.join(leaks, found, "left_anti").select("item.*")


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
