"""Streams over several micro-batches give what the batch operators give."""

import json
import os
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import START
from sentryspark.operators.alerting import NoiseLimits
from sentryspark.operators.rollups import agent_activity_daily
from sentryspark.operators.rules import MATCH_COLUMNS, evaluate
from sentryspark.operators.sessions import session_alert_rollup, sessions
from sentryspark.plans.detection import run_detection
from sentryspark.schema import RULES, SUPPRESSIONS
from sentryspark.sources.alert_store import read_alerts, read_links, read_outbox
from sentryspark.sources.batches import read_table
from sentryspark.sources.catalog import load_rules
from sentryspark.sources.event_store import read_events
from sentryspark.sources.raw import records_from_text
from sentryspark.sources.rollup_store import merged
from sentryspark.sources.session_store import read_marked_sessions, read_sessions
from sentryspark.streaming.detection import (
    MATCH_SCHEMA, RULE_ERRORS, Folders, Lateness, alert_batch, grouped_hits, ingest_batch, keep_running,
    read_late, read_matches, start_alerts, start_detection, start_flow, stream_rules, write_matches,
    write_stream,
)
from test_detection import TOOL, rule, window

LIMITS = NoiseLimits(dedup_ms=120_000, throttle_limit=3, throttle_ms=600_000)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every stateful operator keeps a state store per partition; small tables need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([
        rule("one", condition={**TOOL, "value": "a"}),
        rule("many", "Temporal", window(400, 3), condition={**TOOL, "value": "a"}),
        rule("chain", "Sequence", steps=["a", "b", "c"], span=60),
    ], RULES)


@pytest.fixture
def mixed(make_events):
    kinds = "aabacabbcaacbabc" * 6
    return make_events(*[
        {"event_type": kind, "at": 17 * i, "session_id": f"s{i % 2}", "agent_id": f"a{i % 3}"}
        for i, kind in enumerate(kinds)
    ])


def as_files(frame, folder, write, parts=3):
    """Split a frame by time into files that a stream reads one by one in order."""
    write(frame.repartitionByRange(parts, "timestamp").sortWithinPartitions("timestamp"), folder)
    for age, path in enumerate(sorted(Path(folder).glob("part*"))):
        os.utime(path, (1_700_000_000 + 100 * age,) * 2)


def same_rows(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def no_suppressions(spark):
    return spark.createDataFrame([], SUPPRESSIONS)


def test_all_rule_kinds_in_one_query(spark, mixed, catalog, tmp_path):
    rules, _ = load_rules(catalog)
    as_files(mixed, f"{tmp_path}/in", lambda f, p: f.write.parquet(p))
    stream = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1)
    folders = Folders(f"{tmp_path}/out")
    write_stream(
        stream_rules(stream.parquet(f"{tmp_path}/in"), rules), "rules", folders,
        lambda frame, batch_id: write_matches(frame.where("NOT late"), "rules", batch_id, folders.root),
        True).awaitTermination()
    got = read_matches(spark, folders.root)
    assert got.select("batch_id").distinct().count() >= 3
    wanted = evaluate(mixed, rules)
    assert {r.rule_id for r in wanted.collect()} == {"one", "many", "chain"}
    assert same_rows(got.select(*MATCH_COLUMNS), wanted)


def test_alerts(spark, mixed, catalog, tmp_path):
    rules, _ = load_rules(catalog)
    matches = evaluate(mixed, rules)
    as_files(matches, f"{tmp_path}/in", lambda f, p: f.write.parquet(p))
    stream = spark.readStream.schema(MATCH_SCHEMA).option("maxFilesPerTrigger", 1)
    suppressions = spark.createDataFrame(
        [("s", None, "a1", "", "me", START, START + timedelta(minutes=5))], SUPPRESSIONS)
    folders = Folders(f"{tmp_path}/out")
    start_alerts(stream.parquet(f"{tmp_path}/in"), lambda: mixed, lambda: catalog,
                 lambda: suppressions, folders, LIMITS, available_now=True).awaitTermination()
    got = read_alerts(spark, folders.root)
    wanted = run_detection(mixed, catalog, suppressions, limits=LIMITS).alerts
    columns = ["alert_id", "title", "detail", "triggered_at"]
    assert wanted.count() > 3
    assert same_rows(got.select(*columns), wanted.select(*columns))
    assert read_outbox(spark, folders.root).where("channel = 'live'").count() == wanted.count()


def messages(spark, mixed, folder, parts=3):
    message = F.to_json(F.struct(
        F.col("event_id").alias("toolInput"), F.col("event_type").alias("eventType"),
        F.col("session_id").alias("SESSIONID"), F.col("agent_id").alias("agentId"),
        F.col("agent_name").alias("agentName"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")))
    lines = mixed.select("timestamp", message.alias("value"))
    as_files(lines, folder, lambda f, p: f.select("value").write.text(p), parts=parts)
    Path(f"{folder}/part-99999.txt").write_text("broken\n" + json.dumps({"eventType": "other"}) + "\n")
    os.utime(f"{folder}/part-99999.txt", (1_700_009_000,) * 2)
    return records_from_text(spark.readStream.option("maxFilesPerTrigger", 1).text(folder))


def test_flow_from_topic_to_alerts(spark, mixed, catalog, tmp_path):
    folders = Folders(f"{tmp_path}/out")
    broken = catalog.union(spark.createDataFrame([rule("bad", condition={"type": "?"})], RULES))
    queries = start_flow(
        messages(spark, mixed, f"{tmp_path}/in"), folders, lambda: broken,
        lambda: no_suppressions(spark), limits=LIMITS, available_now=True)
    for query in queries:
        query.awaitTermination()
    root = folders.root
    events = read_events(spark, root)
    assert events.count() == mixed.count() + 1
    assert events.select("batch_id").distinct().count() >= 3
    assert read_table(spark, root, "dead_letters", "value BINARY").count() == 1
    errors = read_table(spark, root, "rule_errors", RULE_ERRORS)
    assert {row.rule_id for row in errors.collect()} == {"bad"}
    # Topic records make their own event ids; the stored events are the ones to compare with.
    wanted = run_detection(events, catalog, no_suppressions(spark), limits=LIMITS).alerts
    columns = ["alert_id", "title", "detail", "triggered_at", "session_id"]
    got = read_alerts(spark, root)
    assert wanted.count() > 5 and {r.rule_id for r in wanted.collect()} == {"one", "many", "chain"}
    assert same_rows(got.select(*columns), wanted.select(*columns))
    assert read_links(spark, root).count() == wanted.count()
    marked = session_alert_rollup(sessions(events), wanted)
    names = ["session_id", "event_count", "has_alerts", "alert_count", "max_severity"]
    assert same_rows(read_marked_sessions(spark, root).select(*names), marked.select(*names))
    daily = agent_activity_daily(events)
    assert same_rows(merged(spark, root, "agent_activity_daily").select(*daily.columns), daily)


TABLES = {"matches": MATCH_SCHEMA, "late_events": MATCH_SCHEMA, "alerts": "alert_id STRING",
          "alert_events": "alert_id STRING", "outbox": "alert_id STRING", "session_marks": "alert_id STRING"}


def test_replayed_alert_batches_leave_nothing_behind(spark, mixed, catalog, tmp_path):
    folders = Folders(str(tmp_path))
    rules, _ = load_rules(catalog)
    found = evaluate(mixed, rules).withColumn("late", F.col("rule_id") == "many")

    def run(rows, batch_id):
        alert_batch(rows, batch_id, folders, catalog, mixed, no_suppressions(spark))

    def counts():
        return {name: read_table(spark, str(tmp_path), name, schema).count() for name, schema in TABLES.items()}

    run(found.limit(0), 0)
    assert set(counts().values()) == {0}
    run(found, 1)
    many = counts()
    assert min(many.values()) > 3 and many["matches"] + many["late_events"] == found.count()
    run(found.where("rule_id = 'one'").limit(1), 1)
    assert counts() == {**dict.fromkeys(TABLES, 1), "late_events": 0, "outbox": counts()["outbox"]}
    assert 0 < counts()["outbox"] <= 4
    run(found.limit(0), 1)
    assert set(counts().values()) == {0}


def test_replayed_ingest_batches_leave_nothing_behind(spark, mixed, tmp_path):
    folders = Folders(str(tmp_path))
    lines = mixed.select(F.to_json(F.struct(F.col("session_id").alias("sessionId"))).alias("value"))
    for rows in (lines, lines.limit(2), lines.limit(0)):
        ingest_batch(records_from_text(rows), 4, folders)
        assert read_events(spark, folders.root).count() == rows.count()
        held = read_sessions(spark, folders.root).agg(F.coalesce(F.sum("event_count"), F.lit(0))).first()[0]
        assert held == rows.count()
        daily = merged(spark, folders.root, "agent_activity_daily")
        assert daily.agg(F.coalesce(F.sum("event_count"), F.lit(0))).first()[0] == rows.count()


def put(frame, folder, number):
    """One more file for a stream, newer than the ones before."""
    frame.coalesce(1).write.parquet(f"{folder}/{number}")
    for path in Path(f"{folder}/{number}").glob("part*"):
        os.utime(path, (1_700_000_000 + 100 * number,) * 2)


def test_rules_added_between_batches_fire_with_old_state_kept(spark, make_events, catalog, tmp_path):
    events = make_events(*[{"at": 10 * i, "event_type": "a" if i % 2 else "b"} for i in range(8)])
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    folders = Folders(f"{tmp_path}/out")
    old, new = catalog.where("id = 'many'"), catalog.where("id IN ('many', 'one')")

    def run(rules):
        start_detection(source.parquet(f"{tmp_path}/in/*"), lambda: events, lambda: rules,
                        lambda: no_suppressions(spark), folders, available_now=True,
                        limits=NoiseLimits(1, 1000, 1)).awaitTermination()

    # Two of three events that the window rule counts come before the restart, one after it.
    put(events.where("event_id < 'e0005'"), f"{tmp_path}/in", 0)
    run(old)
    assert read_matches(spark, folders.root).count() == 0
    put(events.where("event_id >= 'e0005'"), f"{tmp_path}/in", 1)
    run(new)
    found = {(r.rule_id, r.event_id) for r in read_matches(spark, folders.root).collect()}
    assert found == {("many", "e0005"), ("many", "e0007"), ("one", "e0005"), ("one", "e0007")}


def test_changed_rules_restart_the_query(spark, make_events, catalog, tmp_path):
    events = make_events(*[{"at": i, "event_type": "a"} for i in range(4)])
    folders = Folders(f"{tmp_path}/out")
    put(events.where("event_id < 'e0002'"), f"{tmp_path}/in", 0)
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/*")
    state = {"rules": catalog.where("id = 'many'"), "polls": 0}

    def start():
        return start_detection(source, lambda: events, lambda: state["rules"], lambda: no_suppressions(spark),
                               folders, limits=NoiseLimits(1, 1000, 1))

    def stopped():
        state["polls"] += 1
        if state["polls"] == 2:
            state["rules"] = catalog.where("id = 'one'")
            put(events.where("event_id >= 'e0002'"), f"{tmp_path}/in", 1)
        return read_matches(spark, folders.root).where("rule_id = 'one'").count() > 0 or state["polls"] > 60

    assert keep_running(start, lambda: state["rules"], stopped, 2) == 2
    assert read_matches(spark, folders.root).count() > 0


def test_late_rows_are_kept_aside(spark, make_events, catalog, tmp_path):
    events = make_events(
        {"at": 7200, "event_type": "a"}, {"at": 7200 - 540, "event_type": "a", "agent_id": "a2"}, {"at": 7200 - 660, "event_type": "a"},
        {"at": 7200 - 3000, "event_type": "a"}, {"at": 7210, "event_type": "a"})
    for number, where in enumerate(["event_id = 'e0000'", "event_id <> 'e0000'"]):
        put(events.where(where), f"{tmp_path}/in", number)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    folders = Folders(f"{tmp_path}/out")
    start_detection(source.parquet(f"{tmp_path}/in/*"), lambda: events, lambda: catalog.where("id = 'one'"),
                    lambda: no_suppressions(spark), folders, available_now=True, limits=NoiseLimits(1, 1000, 1),
                    lateness=Lateness(timedelta(minutes=10), timedelta(hours=1))).awaitTermination()
    assert {r.event_id for r in read_late(spark, folders.root).collect()} == {"e0002", "e0003"}
    assert {r.event_id for r in read_matches(spark, folders.root).collect()} == {"e0000", "e0001", "e0004"}
    assert read_alerts(spark, folders.root).count() == 3


def test_a_hot_key_is_cut_into_time_blocks_with_equal_counts(spark, make_events, tmp_path):
    hour = 3600
    rows = [{"at": 300 * i, "event_type": "a", "session_id": f"s{i % 7}"} for i in range(10 * 12)]
    events = make_events(*rows)
    catalog = spark.createDataFrame([
        rule("long", "Temporal", window(2 * hour, 20), condition={**TOOL, "value": "a"}),
        rule("short", "Temporal", window(900, 3), condition={**TOOL, "value": "a"}),
        rule("chain", "Sequence", steps=["a", "a", "a"], span=3 * hour)], RULES)
    rules, _ = load_rules(catalog)
    groups = grouped_hits(events, rules).groupBy("rule_id", "key", "block").agg(
        F.count_if(~F.col("prior")).alias("own"), F.count_if("prior").alias("prior")).collect()
    most = {name: max(r.own for r in groups if r.rule_id == name) for name in ("long", "short")}
    assert most == {"long": 24, "short": 12}
    assert {r.prior for r in groups if r.rule_id == "short"} <= {0, 2}
    assert sum(r.own for r in groups if r.rule_id == "long") == len(rows)
    as_files(events, f"{tmp_path}/in", lambda f, p: f.write.parquet(p))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    folders = Folders(f"{tmp_path}/out")
    write_stream(
        stream_rules(stream.parquet(f"{tmp_path}/in"), rules), "rules", folders,
        lambda frame, batch_id: write_matches(frame.where("NOT late"), "rules", batch_id, folders.root),
        True).awaitTermination()
    wanted = evaluate(events, rules)
    assert {r.rule_id for r in wanted.collect()} == {"long", "short", "chain"}
    assert same_rows(read_matches(spark, folders.root).select(*MATCH_COLUMNS), wanted)
