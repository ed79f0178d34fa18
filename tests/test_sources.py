"""Decoding, dead letters, stores, retention, re-layout and roll-up refresh."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import START
from sentryspark.functions.normalize import EVENT_TYPE_ALIASES, normalize_event_type
from sentryspark.operators.rollups import (
    agent_activity_daily, agent_activity_hourly, tool_usage_hourly,
)
from sentryspark.operators.search import newest_first, paged, search_events
from sentryspark.operators.sessions import sessions
from sentryspark.plans.risk import agent_risk_summary
from sentryspark.schema import ALERTS, LIST_MEMBERS, LISTS
from sentryspark.sources.catalog import list_summary, load_lists
from sentryspark.sources.batches import Batch, day_of, table_folders, vacuum
from sentryspark.sources.event_store import (
    apply_retention, compact_events, read_events, write_event_batch, write_events,
)
from sentryspark.sources.raw import (
    decode_events, dead_letters, normalize_events, records_from_text,
)
from sentryspark.sources.rollup_store import (
    add_states, merged, read_rollup, refresh, refresh_window,
)
from sentryspark.sources.session_store import read_sessions, write_session_batch

BAD = ["not json", "null", "[1]", '{"inputTokens":"12"}', '{"inputTokens":12.0}',
       '{"eventId":null}', '{"timestamp":"yesterday"}', '{"toolName":5}', '{"extra":[1]}',
       '{"inputTokens":3000000000}', '{"latencyMs":"5"}', ""]


def decoded(spark, lines):
    return decode_events(records_from_text(spark.createDataFrame([(t,) for t in lines], "value STRING")))


def test_wrong_messages_become_dead_letters(spark):
    kept, bad = decoded(spark, BAD + ['{"AGENTID":"x"}'])
    assert kept.count() == 1
    rows = dead_letters(bad).collect()
    assert sorted(bytes(r["value"]).decode() for r in rows) == sorted(BAD)
    assert {r["topic"] for r in rows} == {"files.dead-letter"}
    kinds = {bytes(r["value"]).decode(): {h["key"]: bytes(h["value"]).decode() for h in r["headers"]}
             for r in rows}
    assert kinds["null"]["x-error-type"] == "InvalidOperationException"
    assert kinds["[1]"]["x-retry-count"] == "0"
    assert all(len(k["x-error-message"]) <= 500 for k in kinds.values())


def test_original_headers_are_kept(spark):
    _, bad = decoded(spark, ["x"])
    marked = bad.withColumn("headers", F.expr("array(named_struct('key', 'h', 'value', binary('v')))"))
    assert dead_letters(marked).first()["headers"][-1]["key"] == "x-orig-h"


def test_events_are_normalised(spark):
    lines = ['{"AgentID":"x","extra":{"d":1.0,"a":{"b": 1}},"unknown":1,"eventType":"GEN_AI.chat"}',
             '{"eventId":"3F2504E0-4F89-11D3-9A0C-0305E82C3301","timestamp":"2024-01-01T10:00:00.5Z",'
             '"latencyMs":5,"inputTokens":7}',
             '{"agentid":"a","agentId":"b","sessionId":"dup"}']
    first = normalize_events(decoded(spark, lines)[0])
    rows = {r["agent_id"]: r for r in first.collect()}
    assert rows["x"]["properties"] == '{"d":1.0,"a":{"b":1}}'
    assert (rows["x"]["event_type"], rows["x"]["agent_name"], rows["x"]["session_id"]) == (
        "llm_call", "unknown", "")
    assert rows["unknown"]["event_id"] == "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
    assert rows["unknown"]["timestamp"] == datetime(2024, 1, 1, 10, 0, 0, 500_000)
    assert rows["b"]["session_id"] == "dup"
    again = normalize_events(decoded(spark, lines)[0])
    assert {r["event_id"] for r in again.collect()} == {r["event_id"] for r in rows.values()}


def test_event_type_names(spark):
    names = [a for aliases in EVENT_TYPE_ALIASES.values() for a in aliases] + ["My.Own"]
    frame = spark.createDataFrame([(n.upper(),) for n in names], "t STRING")
    got = [r[0] for r in frame.select(normalize_event_type(F.col("t"))).collect()]
    wanted = [k for k, aliases in EVENT_TYPE_ALIASES.items() for _ in aliases] + ["my.own"]
    assert got == wanted


def test_store_scan_prunes_days_and_replays_replace(spark, make_events, tmp_path):
    path = f"{tmp_path}/events"
    events = make_events(*[{"at": 86_400 * d + 5} for d in range(5)])
    write_event_batch(events, 1, path)
    write_event_batch(events, 1, path)
    assert read_events(spark, path).count() == 5
    found = read_events(spark, path, START + timedelta(days=1), START + timedelta(days=2, hours=1))
    assert [r["event_id"] for r in found.orderBy("timestamp").collect()] == ["e0001", "e0002"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_retention_drops_whole_days_only(spark, make_events, tmp_path):
    path = f"{tmp_path}/events"
    write_events(make_events(*[{"at": 86_400 * d + 50_000} for d in range(4)]), path)
    as_of = START + timedelta(days=92, hours=12)
    assert [d.day for d in apply_retention(spark, path, "agent_events", as_of)] == [1, 2]
    assert read_events(spark, path).count() == 2


def test_compaction_swaps_and_merges(spark, make_events, tmp_path):
    root = str(tmp_path)
    rows = [{"at": 3600 * h, "session_id": f"s{h}", "agent_id": f"a{h % 2}"} for h in range(60)]
    as_of = START + timedelta(days=9)
    ids = lambda: sorted(r.event_id for r in read_events(spark, root).collect())
    for batch_id in range(3):
        write_event_batch(make_events(*rows).where(f"hash(event_id) % 3 = {batch_id - 1}"), batch_id, root)
    write_events(make_events(*rows).where("abs(hash(event_id) % 3) = 3"), root)
    before = ids()
    assert len(before) == len(set(before)) > 30
    assert compact_events(spark, root, as_of) == [START.date(), START.date() + timedelta(days=1)]
    assert ids() == before
    folders = [f for f in table_folders(spark, root, "events") if day_of(f) == START.date()]
    assert len(folders) == 1 and "source=compact" in folders[0]
    # Nothing new: nothing is written. A late batch touches its own day alone.
    assert compact_events(spark, root, as_of) == []
    write_event_batch(make_events({"at": 90_000, "event_id": "late"}), 7, root)
    assert ids() == sorted([*before, "late"])
    assert compact_events(spark, root, as_of) == [START.date() + timedelta(days=1)]
    assert ids() == sorted([*before, "late"])
    assert vacuum(spark, root, "events") and not vacuum(spark, root, "events")
    assert ids() == sorted([*before, "late"])


def test_heavy_days_get_more_files(spark, make_events, tmp_path):
    write_events(make_events(*[{"at": i, "tool_input": f"{i}" * 50} for i in range(400)]), str(tmp_path))
    compact_events(spark, str(tmp_path), START + timedelta(days=9), file_bytes=2_000)
    assert len(read_events(spark, str(tmp_path)).inputFiles()) > 3


def test_states_add_up_to_the_rollups(spark, make_events, tmp_path):
    kinds = ["tool_invocation", "llm_call"]
    events = make_events(*[
        {"at": 1700 * i, "event_type": kinds[i % 2], "tool_name": [None, "x", "y"][i % 3], "agent_id": f"a{i % 2}",
         "session_id": f"s{i % 5}", "latency_ms": [None, 3.5, 8.25, 1.0][i % 4], "input_tokens": i,
         "output_tokens": None if i % 7 == 0 else 2} for i in range(120)])
    root = str(tmp_path)
    for batch_id in range(4):
        batch = Batch(spark, root, "ingest", batch_id)
        add_states(batch, events.where(f"pmod(hash(event_id), 4) = {batch_id}"))
        batch.commit()
    builds = {"agent_activity_hourly": agent_activity_hourly, "agent_activity_daily": agent_activity_daily,
              "tool_usage_hourly": tool_usage_hourly}
    for name, build in builds.items():
        wanted, got = build(events), merged(spark, root, name)
        assert rounded_rows(got.select(*wanted.columns)) == rounded_rows(wanted)


def rounded_rows(frame):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in row]) for row in frame.collect())


def test_refresh_takes_the_buckets_of_its_window(spark, make_events, tmp_path):
    root = str(tmp_path)
    assert refresh_window("agent_activity_hourly", START + timedelta(hours=5, minutes=4)) == (
        START + timedelta(hours=3), START + timedelta(hours=4))
    assert refresh_window("agent_activity_hourly", START + timedelta(hours=5, minutes=5)) == (
        START + timedelta(hours=3), START + timedelta(hours=5))
    assert refresh_window("agent_activity_daily", START + timedelta(days=4)) == (
        START + timedelta(days=1), START + timedelta(days=3))

    def ingest(batch_id, *rows):
        batch = Batch(spark, root, "ingest", batch_id)
        add_states(batch, make_events(*rows))
        batch.commit()

    counts = lambda: {r.bucket.hour: r.event_count for r in read_rollup(
        spark, root, "agent_activity_hourly").collect()}
    ingest(0, {"at": 10}, {"at": 3700}, {"at": 7300})
    refresh(spark, root, "agent_activity_hourly", START + timedelta(hours=2, minutes=10))
    assert counts() == {0: 1, 1: 1}
    # Late events of hours inside the next window count, older ones no more.
    ingest(1, {"at": 20, "event_id": "x"}, {"at": 3800, "event_id": "y"})
    refresh(spark, root, "agent_activity_hourly", START + timedelta(hours=4, minutes=10))
    assert counts() == {0: 1, 1: 1, 2: 1}
    refresh(spark, root, "agent_activity_hourly", START + timedelta(hours=3, minutes=59))
    assert counts() == {0: 1, 1: 2, 2: 1}


def test_session_partials_merge(spark, make_events, tmp_path):
    path = f"{tmp_path}/sessions"
    first = make_events({"at": 5, "agent_name": "first"}, {"at": 9})
    second = make_events({"at": 1, "agent_name": "late"}, {"at": 20, "session_id": "s2"})
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        write_session_batch(batch, batch_id, path)
    row = read_sessions(spark, path).where("session_id = 's1'").first()
    assert (row["agent_name"], row["event_count"]) == ("first", 3)
    assert row["last_event_at"] == START + timedelta(seconds=9)
    whole = sessions(first).first()
    assert (whole["started_at"], whole["event_count"]) == (START + timedelta(seconds=5), 2)


def test_lists(spark):
    now = START
    lists = spark.createDataFrame([("l1", "b", "", True, now, now), ("l2", "a", "", False, now, now),
                                   ("l3", "c", "", True, now, now)], LISTS)
    members = spark.createDataFrame([("l1", "x", now), ("l1", "y", now), ("l2", "z", now)],
                                    LIST_MEMBERS)
    assert sorted(map(tuple, load_lists(lists, members).collect())) == [("l1", "x"), ("l1", "y")]
    got = [(r["name"], r["member_count"]) for r in list_summary(lists, members).collect()]
    assert got == [("a", 1), ("b", 2), ("c", 0)]


def test_paging_and_search(spark, make_events):
    events = make_events(*[{"at": i, "properties": json.dumps({"documentId": f"d-{i}"})}
                           for i in range(10)])
    page = paged(events, newest_first(("timestamp", "event_id")), 2, 3, 500)
    assert ([r["event_id"] for r in page.rows.collect()], page.total, page.pages) == (
        ["e0006", "e0005", "e0004"], 10, 4)
    as_of = START + timedelta(minutes=30)
    assert search_events(events, as_of, properties='{"documentId":"d-4"}').count() == 1
    assert search_events(events, as_of + timedelta(hours=1)).count() == 0


def test_unknown_agent_has_a_zero_row(spark, make_events):
    alerts = spark.createDataFrame([], ALERTS)
    row = agent_risk_summary(make_events({}), alerts, START + timedelta(hours=1), "nobody").first()
    assert (row["agent_name"], row["total_events"], row["avg_latency_ms"], row["top_tools"]) == (
        None, 0, 0.0, "{}")
    row = agent_risk_summary(make_events({}, {}), alerts, START + timedelta(hours=1)).first()
    assert (row["agent_id"], row["total_events"]) == ("a1", 2)
