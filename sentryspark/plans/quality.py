"""Checks of ingest and load: losses, throughput, latency, event mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentryspark.operators.percentiles import exact_percentiles


def ingest_audit(events: DataFrame) -> DataFrame:
    """Per session: rows, distinct traces and the rows delivered more than once."""
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("trace_id").alias("unique_traces"),
    ).withColumn("duplicates", F.col("total_rows") - F.col("unique_traces"))


def latency_stats(events: DataFrame, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """Per key: count, mean, maximum and exact p50, p95, p99."""
    totals = events.where(F.col(column).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("maximum")
    )
    ranks = exact_percentiles(events, keys, column, {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    if keys:
        return totals.join(ranks, keys)
    # Both sides are single rows, joined on a constant.
    one = F.lit(1).alias("_one")
    return totals.select("*", one).join(ranks.select("*", one), "_one").drop("_one")


def window_rates(events: DataFrame, seconds: int) -> DataFrame:
    """Events per second in each non-empty tumbling window; ``start`` in window numbers."""
    number = F.floor(F.unix_millis("timestamp") / (seconds * 1000))
    return events.groupBy(number.alias("start")).agg(
        F.count(F.lit(1)).alias("events")
    ).withColumn("rate", F.col("events") / seconds)


def throughput_windows(events: DataFrame, seconds: int = 1, rolling: int = 5) -> DataFrame:
    """Average, extreme and percentile rates, and the lowest rate over rolling windows.

    The average is taken over the whole time from first to last window. A rolling rate sums
    the non-empty windows that start within ``rolling`` windows from each window's start.
    """
    rates = window_rates(events, seconds)
    span = (F.max("start") - F.min("start") + 1) * seconds
    totals = rates.agg(
        (F.sum("events") / span).alias("average_rate"), F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"), F.count(F.lit(1)).alias("window_count"),
    )
    ranks = exact_percentiles(rates, [], "rate", {"p50_rate": 0.50, "p95_rate": 0.95})
    lowest = rolling_events(rates, rolling).agg(
        (F.min("rolling_events") / (rolling * seconds)).alias("min_rolling_rate")
    )
    # All three are single rows, joined on a constant.
    parts = [part.select("*", F.lit(1).alias("_one")) for part in (totals, ranks, lowest)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")


def rolling_events(rates: DataFrame, rolling: int) -> DataFrame:
    """Events in the ``rolling`` windows from each one on; each window adds to at most that
    many earlier starts, so nothing has to be ordered."""
    offsets = F.sequence(F.lit(0), F.lit(rolling - 1))
    spread = rates.select(
        "start", "events", F.explode(offsets).alias("offset")
    ).select((F.col("start") - F.col("offset")).alias("start"), "events", "offset")
    return spread.groupBy("start").agg(
        F.sum("events").alias("rolling_events"),
        F.max(F.col("offset") == 0).alias("is_window"),
    ).where("is_window")


def event_type_mix(events: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Share of each event type next to the share expected of it."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    wanted: Column = F.lit(0.0)
    for name, share in expected.items():
        wanted = F.when(F.col("event_type") == name, F.lit(share)).otherwise(wanted)
    share = F.col("n") / total
    return counts.select(
        "event_type", "n", share.alias("share"), wanted.alias("expected_share"),
        (share - wanted).alias("deviation"),
    )
