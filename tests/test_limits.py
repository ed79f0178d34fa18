"""Limits that must not change results: long ranges, large numbers, odd rules, replays, old days."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sentryspark.functions.json_containment import json_contains
from sentryspark.operators.rules import evaluate
from sentryspark.operators.search import last_hours
from sentryspark.sources.catalog import load_rules
from sentryspark.sources.batches import Batch, vacuum
from sentryspark.sources.event_store import (
    apply_retention, read_events, stored_form, write_event_batch,
)
from sentryspark.sources.rollup_store import add_states, merged

START = datetime(2024, 1, 1)
RULE = ("id STRING, name STRING, description STRING, enabled BOOLEAN, severity STRING, "
        "condition_json STRING, evaluation_type STRING, temporal_config STRING, "
        "sequence_config STRING, actions_json STRING, created_by STRING")
LEAF = '{"type":"field","field":"eventType","operator":"Eq","value":"tool_invocation"}'


def rule(number, kind, temporal=None, sequence=None):
    return (f"r{number}", f"Rule {number}", "", True, "high", LEAF, kind, temporal, sequence, None, "")


def test_last_hours_has_no_upper_limit(spark):
    rows = spark.createDataFrame([(START - timedelta(hours=h),) for h in (1, 719, 900, 1100)], "t TIMESTAMP")
    assert last_hours(rows, "t", 1000, START).count() == 3
    assert last_hours(rows, "t", 0, START).count() == 1


def test_whole_numbers_beyond_doubles_differ(spark):
    texts = ['{"id":9007199254740993}', '{"id":9007199254740992}', '{"id":9007199254740993.0}']
    rows = spark.createDataFrame([(t,) for t in texts], "j STRING")
    found = rows.where(json_contains(F.col("j"), texts[0])).collect()
    assert texts[1] not in {row.j for row in found} and texts[0] in {row.j for row in found}


def test_odd_rules_stop_no_others(spark, make_events):
    step = '{"label":"s","condition":' + LEAF + "}"
    rows = [
        rule(1, "Temporal", '{"windowSeconds":0,"threshold":1,"partitionField":"agentId","aggregation":"Rate"}'),
        rule(2, "Sequence", sequence='{"maxSpanSeconds":60,"steps":[' + ",".join([step] * 64) + "]}"),
        rule(3, "SingleEvent"),
    ]
    rules, errors = load_rules(spark.createDataFrame(rows, RULE))
    assert errors.count() == 0
    found = evaluate(make_events(*({"at": n} for n in range(130))), rules).collect()
    assert sum(row.rule_id == "r3" for row in found) == 130
    # 64 steps: the events number 64 and 128 end a round each.
    assert sorted(row.event_id for row in found if row.rule_id == "r2") == ["e0063", "e0127"]


def test_replay_with_fewer_rows_replaces_the_batch(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    events = make_events({"at": 1}, {"at": 90_000}, {"at": 2})
    write_event_batch(events, 7, path)
    write_event_batch(events.where("event_id = 'e0000'"), 7, path)
    assert [row.event_id for row in read_events(spark, path).collect()] == ["e0000"]


def test_replay_with_no_rows_leaves_none(spark, make_events, tmp_path):
    path = str(tmp_path)
    write_event_batch(make_events({"at": 1}, {"at": 90_000}), 7, path)
    write_event_batch(make_events({"at": 5}), 8, path)
    write_event_batch(make_events({"at": 1}).where("false"), 7, path)
    assert [row.batch_id for row in read_events(spark, path).collect()] == [8]


def test_uncommitted_batches_are_invisible(spark, make_events, tmp_path):
    path = str(tmp_path)
    write_event_batch(make_events({"at": 1}), 0, path)
    Batch(spark, path, "ingest", 1).write("events", stored_form(make_events({"at": 2})), "event_date")
    assert read_events(spark, path).count() == 1
    assert len(vacuum(spark, path, "events")) == 1
    assert read_events(spark, path).count() == 1


def test_retention_drops_old_days(spark, make_events, tmp_path):
    path = str(tmp_path)
    write_event_batch(make_events({"at": 0}, {"at": 86_400}, {"at": 86_400 * 5}), 0, path)
    as_of = START + timedelta(days=92)
    assert apply_retention(spark, path, "agent_events", as_of) == [START.date(), START.date() + timedelta(days=1)]
    assert read_events(spark, path).count() == 1
    assert apply_retention(spark, path, "agent_events", as_of) == []


def test_retention_drops_old_roll_up_buckets(spark, make_events, tmp_path):
    path = str(tmp_path)
    batch = Batch(spark, path, "ingest", 0)
    add_states(batch, make_events({"at": -86_400 * 1_200}, {"at": 0}))
    batch.commit()
    apply_retention(spark, path, "agent_activity_daily", START, "activity_states")
    assert [row.bucket for row in merged(spark, path, "agent_activity_daily").collect()] == [START]


def test_reads_of_some_days_open_no_other_folder(spark, make_events, tmp_path):
    path = str(tmp_path)
    for batch_id in range(3):
        write_event_batch(make_events({"at": 86_400 * batch_id}, {"at": 86_400 * 9}), batch_id, path)
    files = read_events(spark, path, START + timedelta(days=1), START + timedelta(days=2)).inputFiles()
    assert len(files) == 2 and all("2024-01-02" in f or "2024-01-03" in f for f in files)
