"""Dashboard reports from stored roll-up states: only the days asked for are read, no event is."""

from __future__ import annotations

from datetime import timedelta

from checks.common import AS_OF, HOURLY, events_of, query
from checks.reports import MONTH, SINCE_DAY, TOP_AGENTS, USAGE, VOLUME
from sentryspark.plans.dashboard import event_volume, tool_usage, top_agents
from sentryspark.session import new_folder
from sentryspark.sources.batches import Batch
from sentryspark.sources.rollup_store import add_states, merged


def stored_states(spark, sf_dir: str, parts: int = 2) -> str:
    """States of the events in a few batches, as the ingest query leaves them."""
    folder = new_folder(spark, "states")
    for part in range(parts):
        batch = Batch(spark, folder, "ingest", part)
        add_states(batch, events_of(spark, sf_dir).where(f"pmod(hash(event_id), {parts}) = {part}"))
        batch.commit()
    return folder


def since(hours: int):
    return AS_OF - timedelta(hours=hours)


def top_agents_of(spark, folder: str):
    return top_agents(merged(spark, folder, "agent_activity_hourly", since(24)), AS_OF)


def event_volume_of(spark, folder: str):
    return event_volume(merged(spark, folder, "agent_activity_hourly", since(MONTH)), AS_OF, MONTH)


def tool_usage_of(spark, folder: str):
    return tool_usage(merged(spark, folder, "tool_usage_hourly", since(MONTH)), AS_OF, MONTH)


# Name of a report from stored states -> its read; ``bench.py`` times the reads alone.
STORED = {"top_agents_stored": top_agents_of, "event_volume_stored": event_volume_of,
          "tool_usage_stored": tool_usage_of}


@query("top_agents_stored", f"WITH {HOURLY} {TOP_AGENTS.format(since=SINCE_DAY, limit=20)}")
def top_agents_stored_query(spark, sf_dir):
    return top_agents_of(spark, stored_states(spark, sf_dir))


@query("event_volume_stored", f"WITH {VOLUME} SELECT * FROM volume ORDER BY bucket")
def event_volume_stored_query(spark, sf_dir):
    return event_volume_of(spark, stored_states(spark, sf_dir))


@query("tool_usage_stored", f"WITH {USAGE} SELECT * FROM usage")
def tool_usage_stored_query(spark, sf_dir):
    return tool_usage_of(spark, stored_states(spark, sf_dir))
