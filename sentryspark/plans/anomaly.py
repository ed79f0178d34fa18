"""Tools used far more than their own baseline."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentryspark.functions.fields import time_bucket

BASELINE_DAYS = 7
Z_THRESHOLD = 2.0


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in deviations; 0 where nothing deviates."""
    return F.when(deviation == 0, F.lit(0.0)).otherwise(F.try_divide(value - mean, deviation))


def tool_anomalies(
    tool_hourly: DataFrame,
    as_of: datetime,
    baseline_days: int = BASELINE_DAYS,
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Tools whose last 24 hours stand out from their daily counts before that.

    Days without use are no zeros but absent; a single day has no deviation and drops out.
    """
    day_ago = F.lit(as_of - timedelta(hours=24))
    bucket = F.col("bucket")
    today = tool_hourly.where(bucket >= day_ago).groupBy("tool_name").agg(
        F.sum("invocation_count").alias("today_count")
    )
    in_baseline = (bucket >= F.lit(as_of - timedelta(days=baseline_days))) & (bucket < day_ago)
    daily = tool_hourly.where(in_baseline).groupBy(
        "tool_name", time_bucket("day", "bucket").alias("day")
    ).agg(F.sum("invocation_count").alias("daily_count"))
    baseline = daily.groupBy("tool_name").agg(
        F.avg("daily_count").alias("avg_daily_count"),
        F.stddev_samp("daily_count").alias("deviation"),
    )
    difference = F.col("today_count") - F.col("avg_daily_count")
    score = F.try_divide(difference, F.nullif(F.col("deviation"), F.lit(0.0)))
    return (
        today.join(baseline, "tool_name").withColumn("z_score", score)
        .where(F.col("z_score") > threshold)
        .select("tool_name", "today_count", "avg_daily_count", "z_score")
        .orderBy(F.desc("z_score"), "tool_name")
    )
