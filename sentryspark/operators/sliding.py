"""Running sums and sliding counts that stay parallel when one key holds most rows.

A key is cut into time blocks, and blocks of many rows into parts (``blocks``). Totals of the parts
are combined before the shuffle, their running sum gives each part's opening balance, and rows are
only ordered inside a (key, block, part).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentryspark.operators.blocks import PLACE, time_blocks

HOUR_MS = 3_600_000


def running_sum(
    df: DataFrame,
    keys: list[str],
    time: str,
    order: list[Column],
    value: str,
    out: str,
    block_ms: int = HOUR_MS,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    ``order`` is the total order and must start with ``time`` (milliseconds). ``keys`` must
    not be NULL.
    """
    blocked = time_blocks(df, keys, time, F.lit(block_ms), block_rows)
    groups = [*keys, *PLACE]
    earlier = (
        Window.partitionBy(*keys).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    )
    opening = (
        blocked.groupBy(*groups)
        .agg(F.sum(value).alias("_total"))
        .select(*groups, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_opening"))
    )
    upto = (
        Window.partitionBy(*groups).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.withColumn("_inside", F.sum(value).over(upto))
        .join(opening, groups)
        .withColumn(out, F.col("_opening") + F.col("_inside"))
        .select(*df.columns, out)
    )


def sliding_count(
    df: DataFrame,
    keys: list[str],
    time: str,
    window: str,
    ties: list[str],
    out: str,
    block_ms: int = HOUR_MS,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: rows of the key in ``(t - window, t]`` up to this one, itself included.

    ``window`` is a column of milliseconds, so rows may carry different windows per key.
    Each row enters at ``t`` and leaves at ``t + window``; the count is the running sum of
    both, which is linear in the rows whatever the window holds. Rows of equal ``t`` count
    in the order of ``ties``.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    leaving = F.struct(
        *keys, (F.col(time) + F.col(window)).alias("_at"), F.lit(-1).alias("_step"),
        F.lit(None).alias("_row"),
    )
    entering = F.struct(
        *keys, F.col(time).alias("_at"), F.lit(1).alias("_step"), row.alias("_row")
    )
    moves = df.select(F.inline(F.array(entering, leaving)))
    order = [F.col("_at"), F.col("_step"), *[F.col(f"_row.{tie}") for tie in ties]]
    counted = running_sum(moves, keys, "_at", order, "_step", out, block_ms, block_rows)
    return counted.where("_step = 1").select(*keys, "_row.*", out)


def sliding_distinct(
    df: DataFrame,
    keys: list[str],
    time: str,
    window_ms: int,
    out: str,
    block_ms: int = HOUR_MS,
) -> DataFrame:
    """Add ``out``: distinct values of ``time`` of the key in ``(t - window_ms, t]``."""
    moments = df.select(*keys, time).distinct().withColumn("_window", F.lit(window_ms))
    counted = sliding_count(moments, keys, time, "_window", [], out, block_ms)
    return df.join(counted.drop("_window"), [*keys, time])
