"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts [native].

Sources get weights in turn and share all words by them, none more than ``most`` times its size;
what is above goes to the others by weight. A source's documents stand in an order by a hash of
their id. The source's budget, its target's whole part, runs through that order as often as it
lasts (epochs); the last epoch ends inside one document, which is cut, so that the words taken
equal the budget.

The keys are uniform, so their leading bits deal a source to buckets of an even number of
documents. Running sums go through each bucket, bucket totals are added up over ranges of buckets;
no task sees a whole source. Repeated rows (source, id and size alike) are one row with a count
from the first, map-side aggregation on, and come apart again at the end, in runs of at most
``RUN``: a repeated id with a third of all rows is no hot key.

Words are separated by ASCII white space; null texts have none. Null sources are one source, last in
order. Documents without a word are taken 0 times. Ties in the key go to smaller ids, null last,
then to smaller sizes. An empty table gives no row, a table without any word targets of 0. Long
texts are counted by one expression. ``mix`` ignores other columns, ``mixed_texts`` keeps them
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentryspark.llm.common import SPACES, WORD_GAP, query, table, written
from sentryspark.llm.ordered import in_order

# Parameters.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 13
BUCKET_ROWS = 1_000  # documents per bucket, about
RUN = 10_000  # copies of a row that one generated array spells out

KEY_DIGITS, KEY_BITS = 15, 60  # leading hex digits of the hash, and their bits
MOST_BITS = 40  # of a bucket number


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: int) -> Column:
    """Hash-random key below 2 ** ``KEY_BITS``; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def water_level(limits: DataFrame) -> float:
    """The level at which all words are shared: a source gets ``level * weight`` or its ``limit``.

    Each round sets the sources above their limit to it and shares the rest anew, until none is
    above. Only sums reach the driver.
    """
    words, weights = limits.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return 0.0
    held = (0.0, 0.0)
    while True:
        level = (float(words) - held[0]) / (weights - held[1])
        full = limits.where(F.col("limit") <= F.col("weight") * level)
        found = tuple(full.agg(F.coalesce(F.sum("limit"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first())
        if found == held or found[1] >= weights:
            return level
        held = found


def shares(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source, from its ``source``, ``source_size`` and ``documents``.

    ``number`` is its place by code point, null last, ``ahead`` the words of the sources before,
    ``target`` its share, ``full`` whole epochs and ``part`` the words of the last one.
    """
    every = F.array(*[F.lit(float(weight)) for weight in weights])
    placed = in_order(written(sizes, "sizes"), [F.col("item.source").asc_nulls_last()],
                      F.col("item.source_size"))
    limits = written(placed.select(
        "item.*", F.col("place").alias("number"), F.col("before").alias("ahead"),
        F.element_at(every, (F.col("place") % len(weights)).cast("int") + 1).alias("weight"),
        (F.col("item.source_size") * float(most)).alias("limit")), "limits")
    target = F.least("limit", F.col("weight") * water_level(limits))
    budget, size = F.floor("target"), F.greatest("source_size", F.lit(1))
    return limits.withColumn("target", target).select(
        "source", "source_size", "documents", "number", "ahead", "target",
        F.floor(budget / size).alias("full"), (budget % size).alias("part"))


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    return documents.select("doc_id", "source", words_in(F.col("text")).alias("size"),
                            key_of(F.col("doc_id"), seed).alias("key"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    match = F.lit(True)
    for name in names:
        match = match & a[name].eqNullSafe(b[name])
    return match


def plan(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Runs of repeated rows with their source's share and ``start``: words of the source before."""
    sized = written(_sized(documents, seed), "sized")
    sources = written(shares(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")),
        weights, most), "shares")
    rows = sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    bits = F.least(F.ceil(F.log2(F.col("documents") / BUCKET_ROWS + 1)), F.lit(MOST_BITS)).cast("int")
    runs = (
        rows.join(sources, _same(rows, sources, ["source"])).drop(sources["source"])
        .withColumn("bucket", F.call_function("shiftright", F.col("key"), F.lit(KEY_BITS) - bits))
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN))))
        .withColumn("copies", F.least(F.col("copies") - F.col("first"), F.lit(RUN)))
    )
    runs = written(runs, "runs")
    totals = runs.groupBy("number", "bucket").agg(
        F.sum(F.col("size") * F.col("copies")).alias("total"), F.first("ahead").alias("ahead"))
    before = in_order(written(totals, "totals"), [F.col("item.number").asc(), F.col("item.bucket").asc()],
                      F.col("item.total"))
    before = before.select("item.number", "item.bucket", (F.col("before") - F.col("item.ahead")).alias("bucket_start"))
    inside = (
        Window.partitionBy("number", "bucket")
        .orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "first")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    so_far = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    return (
        runs.withColumn("so_far", so_far).join(before, ["number", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("so_far"))
    )


def _taken(copy: Column) -> Column:
    """Words taken of a run's copy number ``copy``."""
    beyond = F.col("part") - F.col("start") - copy * F.col("size")
    return F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), beyond))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    runs = plan(documents, weights, most, seed)
    copies = runs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"))


def mixed_texts(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken whole, and the cut ones' first words.

    Columns are those of ``documents`` but for one named ``epoch``, then ``epoch``. A cut text has
    its words joined by blanks.
    Rows alike in source, id and size share their words in the order of their texts.
    """
    runs = plan(documents, weights, most, seed)
    shared = runs.groupBy("source", "doc_id", "size").agg(
        F.min("start").alias("start"), F.first("full").alias("full"), F.first("part").alias("part"),
        F.sum("copies").alias("copies"))
    shared = written(shared, "mix-plan")
    rows = documents.select(F.struct("*").alias("item"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    joined = rows.join(shared, _same(rows, shared, ["source", "doc_id", "size"])).select(
        "item", rows["size"], "start", "full", "part", "copies")
    # Only where the last epoch ends among repeated rows does it matter which of them is which.
    among = (F.col("copies") > 1) & (F.col("part") > F.col("start")) & (
        F.col("part") < F.col("start") + F.col("size") * F.col("copies"))
    tied = written(joined.where(among), "mix-ties")
    order = [F.col("item.item.source").asc_nulls_last(), F.col("item.start").asc(), F.xxhash64("item.item.text").asc()]
    numbered = in_order(tied, order).select("item.*", "place")
    firsts = numbered.groupBy("start", F.col("item.source").alias("source")).agg(F.min("place").alias("least"))
    numbered = numbered.withColumn("source", F.col("item.source"))
    numbered = numbered.join(firsts, _same(numbered, firsts, ["start", "source"])).select(
        "item", "size", numbered["start"], "full", "part", (F.col("place") - F.col("least")).alias("copy"))
    alone = joined.where(~among).select("item", "size", "start", "full", "part", F.lit(0).cast("long").alias("copy"))
    taken = alone.unionByName(numbered).where("size > 0").withColumn("taken", _taken(F.col("copy")))
    names = [name for name in documents.columns if name != "epoch"]
    epochs = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1))) \
        .where("taken > 0")
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    parts = F.filter(F.split(F.col("item.text"), WORD_GAP), lambda word: word != "")
    text = F.when(words == F.col("size"), F.col("item.text")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), words.cast("int")), " "))
    return epochs.select(*[text.alias("text") if name == "text" else F.col(f"item.`{name}`") for name in names], "epoch")


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, {_SIZE} AS size,
    ('0x' || substr(sha256('13:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS top,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(top) OVER ahead, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM sizes
  WINDOW ahead AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT source, source_size, least(top, weight * coalesce((SELECT arg_min(level, top / weight)
    FROM levels WHERE level * weight < top), 0)) AS target
  FROM levels
), epochs AS (
  SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS whole,
    floor(target)::BIGINT % greatest(source_size, 1) AS part FROM shares
), starts AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, part - start)))::BIGINT AS taken
FROM starts s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
"""


@query("op13_source_mixing", SQL)
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
