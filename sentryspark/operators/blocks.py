"""Time blocks of keys, cut further where a block holds many rows.

Work that goes through a key's rows in time order is dealt to tasks by (key, block, sub). Blocks
have a set length; a block with more than ``BLOCK_ROWS`` rows is cut at quantiles of its own
times, so that one key with a third of all rows, or a burst within one block, is many tasks of even size.
Only rows of one and the same millisecond can't be parted.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters: rows of a block that are left together, and cuts per block. A block of more than
# both allow has larger parts.
BLOCK_ROWS = 200_000
MOST_PARTS = 2_000
ACCURACY = 20_000

BLOCK, SUB, SUBS, FROM, UPTO = "_block", "_sub", "_subs", "_from", "_upto"
PLACE = [BLOCK, SUB]


def time_blocks(
    df: DataFrame, keys: list[str], time: str, block_ms: Column, block_rows: int | None = None
) -> DataFrame:
    """Add a row's block and part, the parts of the block, and the part's time range ``[_from, _upto)``.

    ``time`` is in milliseconds, ``block_ms`` is fixed per key, ``keys`` are not NULL. The rows
    are counted before, so ``df`` should be cheap to read.
    """
    block_rows = block_rows or BLOCK_ROWS
    blocked = df.withColumn("_length", block_ms).withColumn(BLOCK, F.floor(F.col(time) / F.col("_length")))
    groups = [*keys, BLOCK]
    heavy = blocked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    most = heavy.agg(F.max("_n")).first()[0]
    start, end = F.col(BLOCK) * F.col("_length"), (F.col(BLOCK) + 1) * F.col("_length")
    if most is None:
        whole = {SUB: F.lit(0).cast("long"), SUBS: F.lit(1).cast("long"), FROM: start, UPTO: end}
        return blocked.withColumns(whole).drop("_length")
    parts = min(ceil(most / block_rows), MOST_PARTS)
    shares = F.array(*[F.lit(part / parts) for part in range(1, parts)])
    cuts = (
        blocked.join(heavy, groups, "left_semi").groupBy(*groups)
        .agg(F.array_distinct(F.percentile_approx(time, shares, ACCURACY)).alias("_cuts"),
             F.max(time).alias("_last"))
        # A cut is a time of the block and not its last, so no part is empty.
        .select(*groups, F.filter("_cuts", lambda cut: cut < F.col("_last")).alias("_cuts"))
    )
    joined = blocked.join(cuts, groups, "left").withColumn(
        "_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    # A cut is the last time of its part.
    placed = joined.withColumn(SUB, F.size(F.filter("_cuts", lambda cut: cut < F.col(time))).cast("long"))
    return placed.withColumns({
        SUBS: (F.size("_cuts") + 1).cast("long"),
        FROM: F.when(F.col(SUB) > 0, F.try_element_at("_cuts", F.col(SUB).cast("int")) + 1).otherwise(start),
        UPTO: F.when(F.col(SUB) < F.size("_cuts"), F.try_element_at("_cuts", (F.col(SUB) + 1).cast("int")) + 1).otherwise(end),
    }).drop("_length", "_cuts")
