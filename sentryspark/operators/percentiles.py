"""Exact interpolated percentiles without gathering a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bin is a 6,000th of its values wide; there are some 40,000 of them per key in ten octaves.
BINS_PER_OCTAVE = 4096


def value_bin(value: Column) -> Column:
    """Order-preserving bin of a double: sign and ``BINS_PER_OCTAVE`` steps per power of two."""
    steps = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + F.lit(10_000_000)
    return (
        F.when(F.isnan(value), F.lit(100_000_000)).when(value == 0, F.lit(0))
        .when(value > 0, steps).otherwise(-steps)
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None
) -> DataFrame:
    """One row per key with the wanted percentiles: output name -> fraction.

    Linear interpolation between the two neighbouring ranks; NULL values are ignored. With
    ``weight`` a row stands for so many equal values. Values are counted per (key, bin, value)
    before anything is ordered; bin totals, added up from these counts, tell which bins hold the
    wanted ranks, and only the values of those bins are ranked.
    """
    binned = df.where(F.col(value).isNotNull()).select(
        *keys, value_bin(F.col(value)).alias("_bin"), F.col(value).alias("_value"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")
    )
    counts = binned.groupBy(*keys, "_bin", "_value").agg(F.sum("_n").alias("_n"))
    totals = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = totals.withColumn("_size", F.sum("_n").over(by_key)).withColumn(
        "_before", F.sum("_n").over(upto) - F.col("_n")
    )
    first = F.col("_before")
    last = F.col("_before") + F.col("_n") - 1
    holds = [rank_inside(place, first, last) for f in wanted.values() for place in places(f)]
    bins = ranked.where(reduce(Column.__or__, holds)).drop("_n")

    in_bin = (
        Window.partitionBy(*keys, "_bin").orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = (
        counts.join(bins, [*keys, "_bin"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(in_bin) - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )
    picks = []
    for name, fraction in wanted.items():
        low, high = places(fraction)
        picks += [
            F.max(F.when(rank_inside(low, F.col("_first"), F.col("_last")), F.col("_value")))
            .alias(f"_low_{name}"),
            F.max(F.when(rank_inside(high, F.col("_first"), F.col("_last")), F.col("_value")))
            .alias(f"_high_{name}"),
        ]
    picked = values.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    return picked.select(*keys, *[interpolated(n, f).alias(n) for n, f in wanted.items()])


def places(fraction: float) -> tuple[Column, Column]:
    """The two neighbouring zero-based ranks of a percentile."""
    place = (F.col("_size") - 1) * F.lit(fraction)
    return F.floor(place), F.ceil(place)


def rank_inside(rank: Column, first: Column, last: Column) -> Column:
    return (rank >= first) & (rank <= last)


def interpolated(name: str, fraction: float) -> Column:
    place = (F.col("_size") - 1) * F.lit(fraction)
    low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
    return low + (high - low) * (place - F.floor(place))
