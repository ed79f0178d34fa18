"""Keyed step machines (ordered sequences, greedy dedup) split across time blocks.

A key is never gathered in one task. Each (key, block, part) first says what it would do to every
state it could be entered in; walking those small tables gives the true entry states; then
all parts run at once from their entry state. Blocks last ``BLOCKS_PER_SPAN`` spans; one of many
rows is cut into parts of even size (``blocks``), which may be shorter than a span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentryspark.operators import chain_kernel
from sentryspark.operators.blocks import FROM, PLACE, SUBS, UPTO, time_blocks

BLOCKS_PER_SPAN = 8
MACHINE = ["n_steps", "span_ms", SUBS, FROM, UPTO]
NUMBERS = ["step_in", "upto", "step_out", "expiry_out", *MACHINE]
ENTRY_NUMBERS = ["step_in", "expiry_in", *MACHINE]


def run_machines(
    rows: DataFrame,
    keys: list[str],
    ties: list[str],
    report: str,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows of ``rows`` at which their key's machine takes its ``first`` or ``last`` step.

    ``rows`` needs ``keys`` (not NULL), ``ms``, ``steps`` (an array of the numbers of the steps the
    row matches), ``n_steps`` and ``span_ms`` (both fixed per key). Order is ``ms`` then ``ties``.
    They are read several times and should come from a written table.
    """
    length = F.greatest(F.col("span_ms"), F.lit(1)) * BLOCKS_PER_SPAN
    blocked = time_blocks(rows, keys, "ms", length, block_rows)
    groups = [*keys, *PLACE]
    needed = [*groups, "ms", *[t for t in ties if t not in groups], "steps", *MACHINE]
    tables = in_groups(blocked.select(*needed), groups, ties).mapInArrow(
        exit_table_job(groups), numbers_schema(blocked, groups, NUMBERS)
    )
    entries = (
        tables.repartition(*keys).sortWithinPartitions(*groups, "step_in", "upto")
        .mapInArrow(entry_state_job(groups), numbers_schema(blocked, groups, ENTRY_NUMBERS))
    )
    # Entry states travel as rows ahead of their part: they match no step.
    ahead = entries.withColumns({
        "ms": F.col(FROM) - 1, "steps": F.array().cast("array<int>"),
    })
    entered = blocked.withColumns({
        "step_in": F.lit(0).cast("long"), "expiry_in": F.lit(0).cast("long"),
    }).unionByName(ahead, allowMissingColumns=True)
    return (
        in_groups(entered, groups, ties)
        .mapInArrow(taken_step_job(groups, report), entered.schema).select(*rows.columns)
    )


def in_groups(df: DataFrame, groups: list[str], ties: list[str]) -> DataFrame:
    """Rows of a group together and in time order.

    Groups are ordered by a hash first: the sort then settles most comparisons on one number.
    """
    return df.repartition(*groups).sortWithinPartitions(
        F.xxhash64(*groups), *groups, "ms", *ties
    )


def numbers_schema(df: DataFrame, groups: list[str], names: list[str]) -> T.StructType:
    fields = [df.schema[name] for name in groups]
    return T.StructType(fields + [T.StructField(name, T.LongType()) for name in names])


def exit_table_job(groups: list[str]):
    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain_kernel.whole_groups(batches, groups):
            yield from chain_kernel.exit_table(batch, groups).to_batches()

    return job


def entry_state_job(groups: list[str]):
    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chain_kernel.entry_states(batches, groups):
            yield from table.to_batches()

    return job


def taken_step_job(groups: list[str], report: str):
    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain_kernel.whole_groups(batches, groups):
            yield from chain_kernel.taken_steps(batch, groups, report).to_batches()

    return job
