"""Array work for ``chains``: follow a step machine through one time block of each key.

The machine of a key is at step ``k`` of ``n``. A row that matches step ``k`` moves it to
``k + 1`` and, short of the last step, sets an expiry of ``span`` after the row; at the last
step the machine is done and starts over. From the expiry on, the machine is back at step 0.

Taking a step at row ``i`` from step ``k`` is node ``(i, k)``. Each node has exactly one
successor, so what a block does is found for all groups of a batch at once by jumping along
successors in powers of two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sentryspark.operators.blocks import FROM, SUBS, UPTO

# Threshold of the exit row that serves every expiry not covered by another row.
ANY_EXPIRY = np.iinfo(np.int64).max
# Step of the exit row for states that leave as they came in.
UNCHANGED = -1
MACHINE = ["n_steps", "span_ms", SUBS, FROM, UPTO]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no (key, block) group is cut in two."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        starts = group_starts(table, keys)
        if held and not same_group(held[-1], table, keys):
            yield pa.concat_tables(held)
            held = []
        last = int(starts[-1])
        if last > 0:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the value of any key changes."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def same_group(left: pa.Table, right: pa.Table, keys: list[str]) -> bool:
    return all(left.column(key)[-1] == right.column(key)[0] for key in keys)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


class BlockNodes:
    """Successor graph of one batch of whole (key, block) groups."""

    def __init__(self, batch: pa.Table, keys: list[str]):
        self.starts = group_starts(batch, keys)
        rows = batch.num_rows
        self.ends = np.append(self.starts[1:], rows)
        self.group = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.time = numbers(batch, "ms")
        self.span = numbers(batch, "span_ms")
        self.steps = numbers(batch, "n_steps")
        self.width = int(self.steps.max())
        # Matching rows of step k: hit_rows[hit_from[k]:hit_from[k + 1]].
        lists = batch.column("steps").combine_chunks()
        matched = lists.flatten().to_numpy(zero_copy_only=False)
        held = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        by_step = np.argsort(matched, kind="stable")
        hit_rows = held[by_step]
        hit_from = np.searchsorted(matched[by_step], np.arange(self.width + 1))
        # First row at or after each row that matches step k, or ``rows`` when none is left
        # in the group. The extra last line answers lookups past the end.
        self.next_match = np.full((rows + 1, self.width), rows, dtype=np.int64)
        index = np.arange(rows)
        row_end = self.ends[self.group]
        for step in range(self.width):
            hit = np.full(rows, rows, dtype=np.int64)
            hits = hit_rows[hit_from[step]:hit_from[step + 1]]
            hit[hits] = hits
            nearest = np.minimum.accumulate(hit[::-1])[::-1]
            self.next_match[:-1, step] = np.where(nearest < row_end, nearest, rows)
        self.rows = rows
        # One ordered axis over all groups: group number first, then time in the group.
        base = self.time[self.starts]
        room = int((self.time - base[self.group]).max() + self.span.max()) + 2
        self.base, self.room = base, room
        self.axis = self.group * room + (self.time - base[self.group])
        self._link()

    def first_at(self, group: np.ndarray, moment: np.ndarray) -> np.ndarray:
        """First row of ``group`` at or after ``moment``; ``rows`` when there is none."""
        offset = np.clip(moment - self.base[group], 0, self.room - 1)
        found = np.searchsorted(self.axis, group * self.room + offset, side="left")
        return np.where(found < self.ends[group], found, self.rows)

    def matched(self, row: np.ndarray, step: np.ndarray | int) -> np.ndarray:
        """``next_match`` for rows that must be inside the group of the caller."""
        return self.next_match[row, step]

    def _link(self) -> None:
        """Successor of every node, and the exit state of nodes whose chain ends here."""
        rows, width = self.rows, self.width
        index = np.arange(rows)
        after = np.where(index + 1 < self.ends[self.group], index + 1, rows)
        expiry = self.time + self.span
        expired_at = self.first_at(self.group, expiry)
        restart = self.matched(expired_at, 0)
        self.successor = np.full((rows + 1, width), -1, dtype=np.int64)
        self.exit_step = np.zeros((rows + 1, width), dtype=np.int64)
        self.exit_expiry = np.zeros((rows + 1, width), dtype=np.int64)
        for step in range(width):
            done = self.steps == step + 1
            wanted = np.where(done, 0, min(step + 1, width - 1))
            target = self.next_match[after, wanted]
            in_time = (target < rows) & (
                done | (self.time[np.minimum(target, rows - 1)] < expiry)
            )
            lapsed = ~done & ~in_time & (restart < rows)
            node = np.where(in_time, target * width + wanted, -1)
            node = np.where(lapsed, restart * width, node)
            self.successor[:-1, step] = node
            waiting = ~done & ~in_time & (expired_at == rows)
            self.exit_step[:-1, step] = np.where(waiting, step + 1, 0)
            self.exit_expiry[:-1, step] = np.where(waiting, expiry, 0)
        flat = self.successor.reshape(-1)
        self.jump = np.where(flat < 0, np.arange(flat.size), flat)

    def chain_ends(self) -> np.ndarray:
        """Last node of the chain through each node."""
        end = self.jump
        while True:
            further = end[end]
            if np.array_equal(further, end):
                return end
            end = further

    def reached(self, entries: np.ndarray) -> np.ndarray:
        """Mark every node on the chains that begin at ``entries``."""
        mark = np.zeros(self.jump.size, dtype=bool)
        mark[entries] = True
        jump = self.jump
        while True:
            mark[jump[mark]] = True
            further = jump[jump]
            if np.array_equal(further, jump):
                return mark
            jump = further

    def entry_nodes(self, step: np.ndarray, expiry: np.ndarray) -> np.ndarray:
        """First node of each group given the state it is entered in; -1 when none."""
        groups = np.arange(len(self.starts))
        row = self.matched(self.starts, step)
        live = (step > 0) & (row < self.rows)
        live &= self.time[np.minimum(row, self.rows - 1)] < expiry
        lapsed = self.first_at(groups, np.where(step > 0, expiry, self.base))
        fresh = self.matched(lapsed, 0)
        node = np.where(fresh < self.rows, fresh * self.width, -1)
        return np.where(live, row * self.width + step, node)


def exit_table(batch: pa.Table, keys: list[str]) -> pa.Table:
    """What each part of a block does to every state it can be entered in.

    Rows read: entered at ``step_in`` with an expiry of at most ``upto`` (the smallest such
    row applies), the part is left at ``step_out`` with ``expiry_out``. An expiry that ends
    inside the part leaves it at step 0, as the next one would see it. In a part shorter than a
    span, a state may wait for a step that no row matches and expire only later: it leaves as it
    came in. Parts that are always left at step 0 have no rows.
    """
    nodes = BlockNodes(batch, keys)
    ends = nodes.chain_ends()
    step_out, expiry_out = nodes.exit_step.reshape(-1), nodes.exit_expiry.reshape(-1)
    low, limit = (numbers(batch, name)[nodes.starts] for name in (FROM, UPTO))
    groups = np.arange(len(nodes.starts))
    steps = nodes.steps[nodes.starts]
    pieces = []

    def add(group: np.ndarray, step: int, upto: np.ndarray, out: np.ndarray, expiry: np.ndarray) -> None:
        pieces.append(np.stack([group, np.full(len(group), step), upto, out, expiry]))

    def follow(group: np.ndarray, step: int, upto: np.ndarray, node: np.ndarray) -> None:
        last = ends[np.maximum(node, 0)]
        out = np.where(node >= 0, step_out[last], 0)
        expiry = np.where(node >= 0, expiry_out[last], 0)
        live = (out > 0) & (expiry > limit[group])
        add(group, step, upto, np.where(live, out, 0), np.where(live, expiry, 0))

    zero = np.zeros(len(groups), dtype=np.int64)
    follow(groups, 0, np.full(len(groups), ANY_EXPIRY), nodes.entry_nodes(zero, zero))
    # A state entered with a later step has an expiry within one span of the part's start.
    horizon = low + nodes.span[nodes.starts]
    edge = nodes.first_at(groups, horizon)
    edge = np.where(edge < nodes.rows, edge, nodes.ends - 1)
    index = np.arange(nodes.rows)
    for step in range(1, nodes.width):
        used = steps > step
        match = nodes.matched(nodes.starts, step)
        lapse_until = np.minimum(edge, match)
        lapses = used[nodes.group] & (index <= lapse_until[nodes.group])
        row = index[lapses]
        fresh = nodes.matched(row, 0)
        node = np.where(fresh < nodes.rows, fresh * nodes.width, -1)
        follow(nodes.group[row], step, nodes.time[row], node)
        meets = used & (match < nodes.rows)
        follow(groups[meets], step, np.full(int(meets.sum()), ANY_EXPIRY),
               match[meets] * nodes.width + step)
        waits = groups[used & (match >= nodes.rows)]
        nothing = np.zeros(len(waits), dtype=np.int64)
        add(waits, step, limit[waits], nothing, nothing)
        # Beyond the limit only in a part that is shorter than a span.
        waits = waits[horizon[waits] > limit[waits]]
        nothing = np.zeros(len(waits), dtype=np.int64)
        add(waits, step, np.full(len(waits), ANY_EXPIRY), nothing + UNCHANGED, nothing)
    group, step_in, upto, out, expiry = distinct_exits(np.concatenate(pieces, axis=1))
    first_rows = pa.array(nodes.starts[group])
    columns = {key: batch.column(key).take(first_rows) for key in keys}
    machine = {name: batch.column(name).take(first_rows) for name in MACHINE}
    return pa.table({
        **columns, "step_in": step_in, "upto": upto, "step_out": out, "expiry_out": expiry, **machine})


def distinct_exits(rows: np.ndarray) -> np.ndarray:
    """Exit rows in lookup order, without parts that always end at step 0, keeping the last
    of neighbouring rows that leave in the same state."""
    group, _, _, out, _ = rows
    alive = np.bincount(group, weights=np.abs(out))[group] > 0
    rows = rows[:, alive]
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    keep = np.ones(rows.shape[1], dtype=bool)
    if keep.size:
        same = rows[[0, 1, 3, 4]]
        keep[:-1] = (same[:, 1:] != same[:, :-1]).any(axis=0)
    return rows[:, keep]


def taken_steps(batch: pa.Table, keys: list[str], report: str) -> pa.Table:
    """Rows of the batch at which the machine takes its first or its last step.

    The first row of a group holds the state in which the block is entered.
    """
    nodes = BlockNodes(batch, keys)
    step = numbers(batch, "step_in")[nodes.starts]
    expiry = numbers(batch, "expiry_in")[nodes.starts]
    entries = nodes.entry_nodes(step, expiry)
    mark = nodes.reached(entries[entries >= 0]).reshape(-1, nodes.width)[:-1]
    if report == "first":
        taken = mark[:, 0]
    else:
        taken = mark[np.arange(nodes.rows), nodes.steps - 1]
    return batch.filter(pa.array(taken))


def entry_states(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Walk exit tables in (key, block, part) order; yield the states left past step 0.

    Each one is the entry state of the part that follows. The walk keeps one state,
    whatever the length of the key; a part without table is left at step 0.
    """
    following, step, expiry = None, 0, 0
    for table in whole_groups(batches, keys):
        starts = group_starts(table, keys)
        ends = np.append(starts[1:], table.num_rows)
        firsts = table.select([*keys, SUBS]).take(pa.array(starts))
        names = list(zip(*(firsts.column(key).to_pylist() for key in keys)))
        parts = firsts.column(SUBS).to_pylist()
        step_in, upto = numbers(table, "step_in"), numbers(table, "upto")
        step_out, expiry_out = numbers(table, "step_out"), numbers(table, "expiry_out")
        found, next_parts, steps, expiries = [], [], [], []
        for position, (name, subs, low, high) in enumerate(zip(names, parts, starts, ends)):
            if name != following:
                step = 0
            row = low
            if step:
                row += np.searchsorted(step_in[low:high], step)
                last = low + np.searchsorted(step_in[low:high], step, side="right")
                row += np.searchsorted(upto[row:last], expiry)
            if step_out[row] != UNCHANGED:
                step, expiry = int(step_out[row]), int(expiry_out[row])
            *key, block, sub = name
            next_part = (block, sub + 1) if sub + 1 < subs else (block + 1, 0)
            following = (*key, *next_part)
            if step:
                found.append(position)
                next_parts.append(next_part)
                steps.append(step)
                expiries.append(expiry)
        if found:
            entered = firsts.take(pa.array(found))
            columns = {key: entered.column(key) for key in keys}
            for column, values in zip(keys[-2:], zip(*next_parts)):
                columns[column] = pa.array(values, entered.schema.field(column).type)
            left = pa.array(starts[found])
            machine = {name: table.column(name).take(left) for name in MACHINE}
            # The part that follows begins where this one ends.
            machine[FROM] = machine[UPTO]
            yield pa.table({**columns, "step_in": steps, "expiry_in": expiries, **machine})
