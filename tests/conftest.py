"""One local session for all tests, and builders for small event tables."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentryspark.schema import EVENTS  # noqa: E402
from sentryspark.session import prepare_streaming  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare_streaming(session)


@pytest.fixture
def make_events(spark):
    """Build canonical events from dicts; ``at`` is the offset in seconds."""

    def build(*rows: dict):
        fields = [part.split()[0] for part in EVENTS.split(",")]
        table = []
        for number, row in enumerate(rows):
            full = {
                "event_id": f"e{number:04d}", "agent_id": "a1", "agent_name": "Agent 1",
                "session_id": "s1", "trace_id": f"t{number}", "event_type": "tool_invocation",
                "properties": "{}", "timestamp": START + timedelta(seconds=row.get("at", number)),
                "ingested_at": START, **row,
            }
            table.append(tuple(full.get(name) for name in fields))
        return spark.createDataFrame(table, EVENTS)

    return build
