"""Event search, alert and session lists, paging and reader views."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentryspark.functions.json_containment import json_contains, json_or_empty
from sentryspark.schema import ALERT_STATES, SEVERITIES

# Default and largest page sizes.
ALERT_PAGE_DEFAULT, ALERT_PAGE_MAX = 50, 200
EVENT_PAGE_MAX = 500
SESSION_PAGE_DEFAULT, SESSION_PAGE_MAX = 50, 200

# Default orders, each closed by a unique key.
EVENT_ORDER = ("timestamp", "event_id")
ALERT_ORDER = ("triggered_at", "alert_id")
SESSION_ORDER = ("last_event_at", "session_id")


def newest_first(order: tuple[str, str]) -> list[Column]:
    """Time descending, then the unique key ascending."""
    return [F.desc(order[0]), F.asc(order[1])]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def equals_if_given(df: DataFrame, **filters: str | None) -> DataFrame:
    """Exact-match filters; blank or missing ones are ignored."""
    for column, wanted in filters.items():
        if wanted is not None and wanted.strip():
            df = df.where(F.col(column) == wanted)
    return df


def in_time_range(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def search_events(
    events: DataFrame,
    as_of: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    agent_id: str | None = None,
    event_type: str | None = None,
    session_id: str | None = None,
    tool_name: str | None = None,
    properties: str | None = None,
) -> DataFrame:
    """Events in a closed time range (the last hour by default) that meet all given filters.

    ``properties`` is a JSON pattern that the event's properties must contain.
    """
    end = end or as_of
    start = start or as_of - timedelta(hours=1)
    found = equals_if_given(
        in_time_range(events, "timestamp", start, end),
        agent_id=agent_id, event_type=event_type, session_id=session_id, tool_name=tool_name,
    )
    if properties is not None and properties.strip():
        found = found.where(json_contains(F.col("properties"), properties))
    return found


def list_alerts(
    alerts: DataFrame,
    status: str | None = None,
    severity: str | None = None,
    agent_id: str | None = None,
) -> DataFrame:
    """Alerts by status, severity and agent; an unknown status or severity filters nothing."""
    status, severity = (status or "").lower(), (severity or "").lower()
    return equals_if_given(
        alerts,
        status=status if status in ALERT_STATES else None,
        severity=severity if severity in SEVERITIES else None,
        agent_id=agent_id,
    )


def list_sessions(
    sessions: DataFrame, agent_id: str | None = None, has_alerts: bool | None = None
) -> DataFrame:
    found = equals_if_given(sessions, agent_id=agent_id)
    return found if has_alerts is None else found.where(F.col("has_alerts") == has_alerts)


def last_hours(df: DataFrame, column: str, hours: int, as_of: datetime) -> DataFrame:
    """Rows whose ``column`` (a bucket start) lies within ``hours`` before ``as_of``."""
    hours = max(hours, 1)
    return df.where(F.col(column) >= F.lit(as_of - timedelta(hours=hours)))


@dataclass(frozen=True)
class Page:
    """One page of rows with the size of the whole result."""

    rows: DataFrame
    total: int
    page: int
    size: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)


def page_rows(
    df: DataFrame, order: list[Column], page: int, size: int, max_size: int
) -> DataFrame:
    """Rows of a 1-based page; page and size are clamped. ``order`` must be total."""
    page, size = max(page, 1), clamp(size, 1, max_size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def paged(df: DataFrame, order: list[Column], page: int, size: int, max_size: int) -> Page:
    page, size = max(page, 1), clamp(size, 1, max_size)
    return Page(page_rows(df, order, page, size, max_size), df.count(), page, size)


def event_view(events: DataFrame) -> DataFrame:
    """Event columns shown to readers: no trace, tool texts, hash or topic position."""
    return events.select(
        "event_id", "timestamp", "agent_id", "agent_name", "session_id", "event_type",
        "model_id", "input_tokens", "output_tokens", "latency_ms", "tool_name",
        json_or_empty(F.col("properties")).alias("properties"),
    )


def alert_view(alerts: DataFrame) -> DataFrame:
    """Alert columns shown to readers; broken JSON reads as an empty object."""
    return alerts.select(
        "alert_id", "rule_id", "rule_name", "severity", "status", "title", "detail",
        json_or_empty(F.col("context")).alias("context"), "agent_id", "session_id",
        "triggered_at", "acknowledged_at", "resolved_at", "assigned_to", "resolution_note",
        json_or_empty(F.col("labels")).alias("labels"),
        "suppressed", "suppressed_by", "suppression_expires_at",
    )


def session_view(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "agent_id", "agent_name", "started_at", "last_event_at", "event_count",
        "has_alerts", "alert_count", "max_severity", json_or_empty(F.col("metadata")).alias("metadata"),
    )
