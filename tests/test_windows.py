"""Sliding counts, step machines and percentiles against plain Python."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentryspark.operators import chain_kernel
from sentryspark.operators.blocks import PLACE, time_blocks
from sentryspark.operators.chains import run_machines
from sentryspark.operators.percentiles import exact_percentiles
from sentryspark.operators.sliding import running_sum, sliding_count, sliding_distinct


# Numbers of the set bits.
STEPS = "filter(sequence(0, 62), k -> (bits >> k) & 1L = 1)"


def plain_machine(rows, steps, span, report):
    """Replay of (key, ms, bits, id) rows through the step machine of each key."""
    states, reported = {}, []
    for key, ms, bits, name in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        step, expiry = states.get(key, (0, 0))
        if step and ms >= expiry:
            step = 0
        if bits >> step & 1:
            if (report == "first" and step == 0) or (report == "last" and step == steps - 1):
                reported.append(name)
            step, expiry = (step + 1) % steps, ms + span
        states[key] = (step, expiry)
    return sorted(reported)


@pytest.mark.parametrize("report", ["first", "last"])
@pytest.mark.parametrize("steps, span, horizon", [
    (1, 5, 300), (2, 1, 60), (2, 10, 3000), (2, 200, 900), (3, 30, 2000), (4, 60, 3000)])
def test_machines_across_blocks(spark, steps, span, horizon, report):
    rng = random.Random(steps * span)
    # Key "h" holds most rows, and its chains cross many blocks.
    rows = [(rng.choice("hhhhab"), rng.randrange(horizon), rng.randrange(1, 2 ** steps), f"{i:04d}")
            for i in range(600)]
    frame = spark.createDataFrame(rows, "key STRING, ms BIGINT, bits BIGINT, id STRING").withColumns(
        {"steps": F.expr(STEPS), "n_steps": F.lit(steps).cast("long"), "span_ms": F.lit(span).cast("long")})
    wanted = plain_machine(rows, steps, span, report)
    # Whole blocks, and blocks cut into parts that are shorter than a span.
    for block_rows in (None, 20, 3):
        got = run_machines(frame, ["key"], ["id"], report, block_rows).select("id").collect()
        assert sorted(r[0] for r in got) == wanted


def test_periodic_rows_never_merge_chains(spark):
    # One row per 7 ms and a window of 50 ms: chains from different starts stay apart.
    rows = [("k", ms, 1, f"{ms:05d}") for ms in range(3, 8000, 7)]
    frame = spark.createDataFrame(rows, "key STRING, ms BIGINT, bits BIGINT, id STRING").withColumns(
        {"steps": F.expr(STEPS), "n_steps": F.lit(2).cast("long"), "span_ms": F.lit(50).cast("long")})
    for block_rows in (None, 5):
        got = run_machines(frame, ["key"], ["id"], "first", block_rows).select("id").collect()
        assert sorted(r[0] for r in got) == plain_machine(rows, 2, 50, "first")


def test_a_hot_key_is_cut_into_even_parts(spark):
    # All rows of one empty session within one block, half of them in a burst.
    rows = [("", 50_000 + n // 2 if n < 2_000 else 40 * n, n) for n in range(4_000)]
    frame = spark.createDataFrame(rows, "key STRING, ms BIGINT, id INT")
    blocks = time_blocks(frame, ["key"], "ms", F.lit(3_600_000), 100)
    sizes = [r["count"] for r in blocks.groupBy(*PLACE).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    assert blocks.where("ms < _from OR ms >= _upto").count() == 0
    whole = time_blocks(frame, ["key"], "ms", F.lit(3_600_000))
    assert whole.groupBy(*PLACE, "_subs").count().count() == 1
    wanted, window = {}, 700
    times = sorted((ms, n) for _, ms, n in rows)
    for at, (ms, n) in enumerate(times):
        wanted[n] = sum(1 for other, _ in times[:at + 1] if other > ms - window)
    counted = sliding_count(frame.withColumn("w", F.lit(window)), ["key"], "ms", "w", ["id"], "n", block_rows=100)
    assert {r.id: r.n for r in counted.collect()} == wanted


def test_groups_are_never_cut_by_batches():
    table = pa.table({"key": list("aaabbbbbc"), "block": [1, 1, 2, 2, 2, 2, 2, 3, 3]})
    for size in (1, 2, 4, 9):
        parts = chain_kernel.whole_groups(table.to_batches(max_chunksize=size), ["key", "block"])
        seen = [g for part in parts
                for g in sorted(set(zip(part["key"].to_pylist(), part["block"].to_pylist())))]
        assert seen == [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3)]


@pytest.mark.parametrize("block_ms", [3, 50, 100_000])
def test_sliding_count_is_the_same_for_any_block(spark, block_ms):
    rng = random.Random(3)
    rows = [(rng.choice("hhha"), rng.randrange(400), f"{i:03d}") for i in range(300)]
    frame = spark.createDataFrame(rows, "k STRING, ms BIGINT, id STRING").withColumn(
        "w", F.when(F.col("k") == "h", 20).otherwise(75))
    got = {r["id"]: r["n"] for r in
           sliding_count(frame, ["k"], "ms", "w", ["id"], "n", block_ms).collect()}
    window = {"h": 20, "a": 75}
    wanted = {
        i: sum(k2 == k and ms - window[k] < m2 and (m2, i2) <= (ms, i) for k2, m2, i2 in rows)
        for k, ms, i in rows
    }
    assert got == wanted


def test_rows_one_window_apart_do_not_meet(spark):
    frame = spark.createDataFrame([("k", 0, "a"), ("k", 10, "b"), ("k", 19, "c")],
                                  "k STRING, ms BIGINT, id STRING").withColumn("w", F.lit(10))
    got = sliding_count(frame, ["k"], "ms", "w", ["id"], "n", 4).orderBy("id").collect()
    assert [r["n"] for r in got] == [1, 1, 2]


def test_distinct_milliseconds_count_once(spark):
    frame = spark.createDataFrame([("r", 5)] * 12 + [("r", 6)], "rule STRING, ms BIGINT")
    got = sliding_distinct(frame, ["rule"], "ms", 100, "n").groupBy("ms", "n").count().collect()
    assert sorted(map(tuple, got)) == [(5, 1, 12), (6, 2, 1)]


def test_running_sum_over_blocks(spark):
    frame = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("ms"),
                                    F.lit(2).alias("v"))
    got = running_sum(frame, ["k"], "ms", [F.col("ms")], "v", "s", 7).orderBy("ms").collect()
    assert [r["s"] for r in got] == [2 * (i + 1) for i in range(100)]


def test_percentiles_match_numpy(spark):
    rng = random.Random(5)
    rows = [(rng.choice("hhhhab"), rng.choice([0.0, -3.5, rng.gauss(50, 40), 1e9]))
            for _ in range(500)] + [("one", 4.5), ("none", None)]
    frame = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = exact_percentiles(frame, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert {r["k"] for r in got} == {"h", "a", "b", "one"}
    for row in got:
        values = [v for k, v in rows if k == row["k"]]
        assert row["p50"] == pytest.approx(statistics.median(values))
        assert row["p95"] == pytest.approx(np.percentile(values, 95))
    everything = exact_percentiles(frame, [], "v", {"p99": 0.99}).first()[0]
    assert everything == pytest.approx(np.percentile([v for _, v in rows if v is not None], 99))
