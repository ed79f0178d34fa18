"""Keyed state of the streaming rules and of the alert noise reduction.

Rows of one micro-batch arrive unordered and are put in (ms, event_id) order first; a batch
is bounded by the source's trigger limit. State that can no longer matter is cleared by
event-time timers once the watermark has passed its expiry.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda row: (row["ms"], row["event_id"]))


class ExpiringProcessor(StatefulProcessor):
    """Shared parts: remember the handle, clear state whose expiry has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "ms BIGINT")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def clear_state(self) -> None:
        raise NotImplementedError

    def keep_until(self, moment: int) -> None:
        """Set the expiry of the key's state and a timer for it."""
        self.expires.update((moment,))
        self.handle.registerTimer(moment)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.expires.exists() and self.expires.get()[0] <= due:
            self.clear_state()
            self.expires.clear()
        return iter([])

    def close(self) -> None:
        pass


class RuleProgress(ExpiringProcessor):
    """State of one group of a rule's hits; emits the rows that fire and, aside, those too late.

    Rows are evaluated while they are at most ``delay_ms`` behind the highest event time of the
    batches before. The stream's watermark lags by ``kept_ms``, so rows between the two limits still get
    here and are passed on marked as late; state is left alone by them. ``facts`` holds the constants
    of every rule by its kind and position.

    A window rule's group is one key and time block; rows marked ``prior`` belong to the block before and
    are counted there only. Its state is one (ms, count) pair per distinct millisecond of a window. A sequence
    rule's group holds many sessions, its state the step and expiry of each unfinished one. A
    single-event rule has none.
    """

    def __init__(self, delay_ms: int, kept_ms: int, facts: dict[tuple[str, int], dict]):
        self.delay_ms, self.kept_ms, self.facts = delay_ms, kept_ms, facts

    def open_state(self, handle):
        self.moments = handle.getListState("moments", "ms BIGINT, n INT")
        self.progress = handle.getListState(
            "progress", "session_id STRING, step INT, expiry BIGINT")

    def clear_state(self):
        self.moments.clear()
        self.progress.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        since = watermark + self.kept_ms - self.delay_ms if watermark > 0 else None
        in_time, prior, kind, facts = [], Counter(), None, {}
        for row in rows:
            if since is not None and row["ms"] < since:
                if not row["prior"]:
                    known = self.facts[row["kind"], row["rule"]]
                    yield matched(row, known.get("detail"), known.get("context"), late=True)
                continue
            if kind is None:
                kind = row["kind"]
                facts = self.facts[kind, row["rule"]]
            if row["prior"]:
                prior[row["ms"]] += 1
            else:
                in_time.append(row)
        if kind is None:
            return
        in_time = in_order(in_time)
        if kind == "Temporal":
            yield from self.count(in_time, prior, since, facts)
        else:
            yield from (self.advance if kind == "Sequence" else self.fire)(in_time, since, facts)

    def fire(self, rows, since, facts) -> Iterator[Row]:
        for row in rows:
            yield matched(row, facts["detail"], facts["context"])

    def count(self, rows, prior, since, facts) -> Iterator[Row]:
        held = sorted((m, n) for m, n in self.moments.get())
        merged = Counter(dict(held)) + Counter(row["ms"] for row in rows) + prior
        moments = sorted(merged)
        totals = dict(zip(moments, accumulate(merged[m] for m in moments)))
        # Rows of a millisecond count one after the other, after those held before the batch.
        seen = Counter(dict(held))
        window, minutes, span = facts["window_ms"], facts["minutes"], facts["span"]
        is_rate, threshold = facts["is_rate"], facts["threshold"]
        for row in rows:
            now = row["ms"]
            seen[now] += 1
            out = bisect_right(moments, now - window)
            count = totals[now] - merged[now] + seen[now] - (totals[moments[out - 1]] if out else 0)
            measure = rate(count, minutes) if is_rate else float(count)
            if measure >= threshold:
                yield matched(row, f"{count} events in {span}", '{"window_count":%d}' % count)
        # Rows may still arrive back to the limit; without one, back to the allowed delay.
        oldest = (moments[-1] - self.delay_ms if since is None else since) - window
        self.moments.put([(m, merged[m]) for m in moments[bisect_right(moments, oldest):]])
        self.keep_until(moments[-1] + window)

    def advance(self, rows, since, facts) -> Iterator[Row]:
        n_steps, span = facts["n_steps"], facts["span_ms"]
        held = {session: (step, expiry) for session, step, expiry in self.progress.get()}
        for row in rows:
            session, now = row["session_id"], row["ms"]
            step, expiry = held.get(session, (0, 0))
            if step and now >= expiry:
                step = 0
            if step in row["steps"]:
                step, expiry = step + 1, now + span
                if step == n_steps:
                    step = 0
                    yield matched(row, facts["detail"], facts["context"])
            if step:
                held[session] = (step, expiry)
            else:
                held.pop(session, None)
        # No row before the limit comes any more, so what expires before it has ended.
        left = [(session, step, expiry) for session, (step, expiry) in held.items()
                if since is None or expiry > since]
        if left:
            self.progress.put(left)
            self.keep_until(max(expiry for _, _, expiry in left))
        else:
            self.progress.clear()


class Dedup(ExpiringProcessor):
    """Accepted time per fingerprint; passes the first row and then none within the window."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def open_state(self, handle):
        self.accepted = handle.getValueState("accepted", "ms BIGINT")

    def clear_state(self):
        self.accepted.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.accepted.get()[0] if self.accepted.exists() else None
        first: dict[int, Row] = {}
        in_time = []
        for row in rows:
            now = row["ms"]
            if row["late"]:
                yield row
            elif self.window_ms <= 0:
                in_time.append(row)
            # Of a millisecond's rows only the first can pass, and none within the window held.
            elif last is None or now >= last + self.window_ms:
                other = first.get(now)
                if other is None or row["event_id"] < other["event_id"]:
                    first[now] = row
        for row in in_order([*in_time, *first.values()]):
            if last is None or row["ms"] >= last + self.window_ms:
                last = row["ms"]
                yield row
        if last is not None:
            self.accepted.update((last,))
            self.keep_until(last + self.window_ms)


class Throttle(ExpiringProcessor):
    """Distinct milliseconds per rule in the window; passes rows up to the limit."""

    def __init__(self, limit: int, window_ms: int, delay_ms: int):
        self.limit, self.window_ms, self.delay_ms = limit, window_ms, delay_ms

    def open_state(self, handle):
        self.moments = handle.getListState("moments", "ms BIGINT")

    def clear_state(self):
        self.moments.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        in_time = []
        for row in in_order(rows):
            if row["late"]:
                yield row
            else:
                in_time.append(row)
        if not in_time:
            return
        # Rows come in time order, so one that came before does not see a later one of the batch.
        times = sorted({row[0] for row in self.moments.get()})
        for row in in_time:
            now = row["ms"]
            at = bisect_right(times, now)
            if at == 0 or times[at - 1] != now:
                times.insert(at, now)
                at += 1
            if at - bisect_right(times, now - self.window_ms) <= self.limit:
                yield row
        oldest = times[-1] - self.delay_ms - self.window_ms
        self.moments.put([(m,) for m in times[bisect_right(times, oldest):]])
        self.keep_until(times[-1] + self.window_ms)


def rate(count: int, minutes: float) -> float:
    """Events per minute; a window of no length has an endless rate once it holds an event."""
    if minutes > 0:
        return count / minutes
    return float("inf") if count else float("-inf")


def matched(row: Row, detail: str, context: str, late: bool = False) -> Row:
    """The match of one event, in the columns of ``MATCH_COLUMNS``, and whether it is late."""
    return Row(
        rule_id=row["rule_id"], severity=row["severity"], event_id=row["event_id"],
        timestamp=row["timestamp"], agent_id=row["agent_id"], agent_name=row["agent_name"],
        session_id=row["session_id"], ms=row["ms"], detail=detail, context=context, late=late,
    )
