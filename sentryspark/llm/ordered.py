"""Places and running sums in a total order, spread over range partitions (DataFrame functions only).

Rows are dealt to ranges of the order and sorted there; a row's place is its place in its range
plus the rows of all ranges before. Only the ranges' totals, one row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentryspark.llm.common import written

# ``monotonically_increasing_id`` keeps the partition from this bit on and the row below it.
ROW_BITS = 33


def in_order(df: DataFrame, order: list[Column], value: Column | None = None) -> DataFrame:
    """``item`` (all columns of ``df`` as a struct), ``place`` (long, from 0) and ``before``.

    ``order`` and ``value`` are written on ``item``; ``before`` is the sum of ``value`` over all
    rows ahead (of 1 where none is given, so the place again). Rows equal in ``order`` are told
    apart by their row number: repeated rows spread over several ranges. ``df`` should be a
    written table, as it is read twice (the ranges' bounds come from a sample).
    """
    rows = df.select(F.struct("*").alias("item"), F.monotonically_increasing_id().alias("row"))
    keys = [*order, F.col("row")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.select("item", F.monotonically_increasing_id().alias("at")), "in-order")
    placed = placed.select(
        "item", F.shiftright("at", ROW_BITS).alias("part"),
        F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"),
        (F.lit(None).cast("long") if value is None else value).alias("value"),
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("value").alias("total")).select(
        "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("total_before"))
    joined = placed.join(F.broadcast(starts), "part")  # one row per range
    place = F.col("rows_before") + F.col("row")
    if value is None:
        return joined.select("item", place.alias("place"), place.alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("total_before") + F.coalesce(F.sum("value").over(inside), F.lit(0))
    return joined.select("item", place.alias("place"), before.alias("before"))
