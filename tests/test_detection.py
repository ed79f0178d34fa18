"""Rules and alert handling on small golden inputs."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START
from sentryspark.functions.alert_text import (
    render_live, render_pagerduty, render_slack, render_webhook, rule_labels, span_text,
)
from sentryspark.operators.alerting import (
    NoiseLimits, dedup, enrich, live_feed, new_outbox, retry_plan, route, suppress, throttle,
    transition_alerts,
)
from sentryspark.operators.rules import MATCH_COLUMNS, eval_sequence, eval_temporal, evaluate
from sentryspark.plans.detection import run_detection
from sentryspark.schema import ALERTS, RULES, SUPPRESSIONS
from sentryspark.sources.catalog import load_rules, rule_catalog_check

TOOL = {"type": "field", "field": "eventType", "operator": "Eq", "value": "tool_invocation"}


def is_type(kind):
    return {**TOOL, "value": kind}


def rule(name, kind="SingleEvent", temporal=None, steps=None, span=300, condition=TOOL,
         severity="high", actions=None):
    sequence = steps and {"maxSpanSeconds": span, "steps": [
        {"label": s, "condition": is_type(s)} for s in steps]}
    return (name, f"Rule {name}", None, True, severity, json.dumps(condition), kind,
            temporal and json.dumps(temporal), sequence and json.dumps(sequence), actions, None,
            "me", None, None)


@pytest.fixture
def rules_of(spark):
    return lambda *rows: load_rules(spark.createDataFrame(list(rows), RULES))[0]


def fired(frame):
    return sorted(r["event_id"] for r in frame.collect())


def window(seconds, threshold, key="agentId", **more):
    return {"windowSeconds": seconds, "threshold": threshold, "partitionField": key, **more}


def test_threshold_five_fires_on_fifth_and_sixth(make_events, rules_of):
    rows = [{"at": 10 * i} for i in range(6)] + [{"at": 5, "event_type": "llm_call"}]
    rules = rules_of(rule("t", "Temporal", window(300, 5)))
    got = eval_temporal(make_events(*rows), rules).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == ["e0004", "e0005"]
    assert got[0]["detail"] == "5 events in 00:05:00"
    assert got[0]["context"] == '{"window_count":5}'


def test_windows_expire_and_keys_are_apart(make_events, rules_of):
    rows = [{"at": 0}, {"at": 1}, {"at": 61}, {"at": 62, "agent_id": "a2"}, {"at": 63}]
    rules = rules_of(rule("t", "Temporal", window(60, 3)))
    assert fired(eval_temporal(make_events(*rows), rules)) == []
    rules = rules_of(rule("g", "Temporal", window(60, 3, "properties.none")))
    assert fired(eval_temporal(make_events(*rows), rules)) == ["e0004"]


def test_rate_fires_on_the_120th(make_events, rules_of):
    rows = [{"at": i * 0.49} for i in range(120)]
    rules = rules_of(rule("r", "Temporal", window(60, 120, aggregation="Rate")))
    assert fired(eval_temporal(make_events(*rows), rules)) == ["e0119"]


SEQUENCES = {
    "in order": ([("a", 0), ("b", 1)], 300, ["e0001"]),
    "out of order": ([("b", 0), ("a", 1)], 300, []),
    "too late": ([("a", 0), ("b", 300)], 300, []),
    "twice": ([("a", 0), ("b", 1), ("a", 2), ("b", 3)], 300, ["e0001", "e0003"]),
    "expired then anew": ([("a", 0), ("a", 400), ("b", 401)], 300, ["e0002"]),
    "first a keeps its expiry": ([("a", 0), ("a", 200), ("b", 350)], 300, []),
    "others do not disturb": ([("a", 0), ("x", 1), ("b", 2)], 300, ["e0002"]),
}


@pytest.mark.parametrize("name", SEQUENCES)
def test_sequences(make_events, rules_of, name):
    rows, span, wanted = SEQUENCES[name]
    events = make_events(*[{"event_type": kind, "at": at} for kind, at in rows])
    assert fired(eval_sequence(events, rules_of(rule("s", "Sequence", steps=["a", "b"], span=span)))) == wanted


def test_three_steps_each_within_the_span_of_the_last(make_events, rules_of):
    events = make_events(*[{"event_type": k, "at": at} for k, at in
                           [("a", 0), ("b", 250), ("c", 500)]],
                         {"event_type": "b", "session_id": "s2", "at": 1})
    got = eval_sequence(events, rules_of(rule("s", "Sequence", steps=["a", "b", "c"]))).collect()
    assert [r["event_id"] for r in got] == ["e0002"]
    assert got[0]["detail"] == "Sequence complete (3 steps, final: c)"
    assert json.loads(got[0]["context"]) == {"sequence_steps": 3, "final_step": "c"}


def test_a_bad_rule_does_not_stop_the_others(spark, make_events):
    bad = [rule("b1", condition={"type": "zz"}), rule("b2", "Temporal", {"threshold": 1}),
           rule("b3", condition={**TOOL, "operator": "Regex", "value": "(?<n"})]
    table = spark.createDataFrame([*bad, rule("good")], RULES)
    good, errors = load_rules(table)
    assert [r.id for r in good] == ["good"]
    assert sorted(r["rule_id"] for r in errors.collect()) == ["b1", "b2", "b3"]
    assert fired(evaluate(make_events({}, {"event_type": "x"}), good)) == ["e0000"]


def test_catalog_check_lists_every_defect(spark):
    row = list(rule("x", "Temporal", severity="loud"))
    row[1], row[5], row[11] = " ", '{"type":"not"}', None
    found = rule_catalog_check(spark.createDataFrame([tuple(row), rule("fine")], RULES)).collect()
    assert {r["id"] for r in found} == {"x"}
    assert len(found) == 5


def test_many_rules_in_chunks(make_events, rules_of):
    rules = rules_of(*[rule(f"r{i:03d}") for i in range(120)])
    assert evaluate(make_events({}), rules).select("rule_id").distinct().count() == 120


@pytest.fixture
def make_matches(spark):
    def build(*rows):
        table = [
            (r.get("rule", "r1"), r.get("severity", "high"), f"e{i:04d}",
             START + timedelta(seconds=r["at"]), r.get("agent", "a1"), "Agent", "s1",
             int(START.timestamp() * 1000 + r["at"] * 1000), "detail", "{}")
            for i, r in enumerate(rows)
        ]
        shape = ("rule_id STRING, severity STRING, event_id STRING, timestamp TIMESTAMP, "
                 "agent_id STRING, agent_name STRING, session_id STRING, ms BIGINT, "
                 "detail STRING, context STRING")
        return spark.createDataFrame(table, shape)

    return build


def test_dedup_windows_start_at_accepted_rows(make_matches):
    rows = [{"at": 60 * m} for m in (0, 10, 15, 29, 30)] + [{"at": 60, "agent": "a2"}]
    assert fired(dedup(make_matches(*rows))) == ["e0000", "e0002", "e0004", "e0005"]


def test_throttle_keeps_ten_and_counts_milliseconds(make_matches):
    spread = make_matches(*[{"at": i} for i in range(12)])
    assert throttle(spread).count() == 10
    together = make_matches(*[{"at": 1} for _ in range(12)])
    assert throttle(together).count() == 12


def test_suppression_cases(spark, make_matches):
    day = timedelta(days=1)

    def row(rule_id, agent_id, start=-day, end=day):
        return ("s", rule_id, agent_id, "", "me", START + start, START + end)

    table = spark.createDataFrame([
        row("rule-only", None), row(None, "agent-only"), row("both", "a1"),
        row("expired", None, -2 * day, -day), row("future", None, day, 2 * day), row(None, None),
    ], SUPPRESSIONS)
    matches = make_matches(
        {"at": 0, "rule": "rule-only"}, {"at": 0, "agent": "agent-only"},
        {"at": 0, "rule": "both"}, {"at": 0, "rule": "both", "agent": "other"},
        {"at": 0, "rule": "expired"}, {"at": 0, "rule": "future"}, {"at": 0})
    assert fired(suppress(matches, table)) == ["e0003", "e0004", "e0005", "e0006"]


def test_whole_flow_and_counters(spark, make_events):
    rows = [{"at": 1000 * i, "tool_name": f"t{i % 3}"} for i in range(6)]
    actions = '[{"type":"create_alert","labels":{"category":"c"}}]'
    catalog = spark.createDataFrame([rule("r", actions=actions)], RULES)
    none = spark.createDataFrame([], SUPPRESSIONS)
    found = run_detection(make_events(*rows), catalog, none, limits=NoiseLimits(dedup_ms=900_000))
    alerts = found.alerts.orderBy("triggered_at").collect()
    assert [a["recent_alert_count"] for a in alerts] == list(range(6))
    assert [a["session_event_count"] for a in alerts] == list(range(1, 7))
    assert [a["recent_tools"] for a in alerts][-1] == ["t0", "t1", "t2"]
    assert alerts[0]["title"] == "[HIGH] Rule r: Agent 1"
    assert alerts[0]["labels"] == {"category": "c"}
    counts = {(r["stage"], r["severity"]): r["n"] for r in found.counters().collect()}
    parts = ("created", "throttled", "suppressed", "deduplicated")
    assert counts["received", "all"] == sum(counts.get((p, "all"), 0) for p in parts) == 6
    history = found.alerts.select("agent_id", "triggered_at")
    again = enrich(found.matches.limit(1), catalog, make_events(*rows), history).first()
    assert again["recent_alert_count"] == 1


@pytest.fixture
def alert_rows(spark):
    def build(*rows):
        frame = spark.createDataFrame(
            [(f"al{i}", s, st, START + timedelta(seconds=i)) for i, (s, st) in enumerate(rows)],
            "alert_id STRING, severity STRING, status STRING, triggered_at TIMESTAMP")
        given = set(frame.columns)
        rest = [f for f in spark.createDataFrame([], ALERTS).schema if f.name not in given]
        return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest}).withColumn(
            "agent_id", F.lit("a1"))

    return build


def test_routing_and_feed(alert_rows):
    alerts = alert_rows(("low", "open"), ("medium", "open"), ("high", "open"), ("critical", "open"))
    counts = {r["severity"]: r["count"] for r in route(alerts).groupBy("severity").count().collect()}
    assert counts == {"low": 1, "medium": 2, "high": 3, "critical": 4}
    feed = live_feed(alerts, 2)
    top = feed.where("topic = 'all'").orderBy("position").collect()
    assert [r["alert_id"] for r in top] == ["al3", "al2"]
    assert feed.where("topic = 'severity:low'").count() == 1


def test_retries_wait_longer_and_end(spark, alert_rows):
    outbox = new_outbox(route(alert_rows(("low", "open"))))
    seen = []
    for attempt in range(3):
        outcome = spark.createDataFrame(
            [("al0", "live", False, START)],
            "alert_id STRING, channel STRING, delivered BOOLEAN, at TIMESTAMP")
        outbox = retry_plan(outbox, outcome)
        row = outbox.first()
        wait = row["next_attempt_at"] and (row["next_attempt_at"] - START).total_seconds()
        seen.append((row["state"], row["attempts"], wait))
    assert seen == [("pending", 1, 30.0), ("pending", 2, 120.0), ("failed", 3, None)]


def test_transitions(spark, alert_rows):
    alerts = alert_rows(("low", "open"), ("low", "acknowledged"), ("low", "resolved"), ("low", "open"))
    commands = spark.createDataFrame(
        [("al0", "acknowledged", START, None), ("al1", "resolved", START, "done"),
         ("al2", "acknowledged", START, None), ("zz", "resolved", START, None),
         ("al3", "resolved", START, None), ("al3", "acknowledged", START + timedelta(1), None)],
        "alert_id STRING, target STRING, decided_at TIMESTAMP, note STRING")
    updated, rejected = transition_alerts(alerts, commands)
    got = {r["alert_id"]: (r["status"], r["resolution_note"]) for r in updated.collect()}
    assert got == {"al0": ("acknowledged", None), "al1": ("resolved", "done"),
                   "al2": ("resolved", None), "al3": ("resolved", None)}
    assert sorted((r["alert_id"], r["error"]) for r in rejected.collect()) == [
        ("al2", "Cannot move from resolved to acknowledged"),
        ("al3", "Only one command per batch"), ("zz", "Alert not found")]


def test_messages(spark):
    alert = spark.createDataFrame(
        [("id1", "r1", "Rule", "critical", "T", "D", '{"window_count":5}', "a1", "Agent", "s1",
          START, {"team": "x"}, 2, 3, list("abcdef"))],
        "alert_id STRING, rule_id STRING, rule_name STRING, severity STRING, title STRING, "
        "detail STRING, context STRING, agent_id STRING, agent_name STRING, session_id STRING, "
        "triggered_at TIMESTAMP, labels MAP<STRING,STRING>, recent_alert_count BIGINT, "
        "session_event_count BIGINT, recent_tools ARRAY<STRING>")
    live, hook, chat, page = (json.loads(v) for v in alert.select(
        render_live(), render_webhook(), render_slack("#c", "http://h"),
        render_pagerduty("key", "http://h")).first())
    assert len(live) == 11 and live["labels"] == {"team": "x"}
    assert len(hook) == 13 and hook["context"] == {"window_count": 5}
    assert [b["type"] for b in chat["blocks"]] == ["header", "section", "section", "actions"]
    facts = [f["text"] for f in chat["blocks"][1]["fields"]]
    assert facts[0] == "*Severity:*\n:rotating_light: critical"
    assert facts[4] == "*Tools used:*\na, b, c, d, e"
    assert chat["blocks"][3]["elements"][1]["url"] == "http://h/sessions/s1"
    assert page["payload"]["group"] == "uncategorized"
    assert page["payload"]["custom_details"]["recent_tools"] == list("abcdef")
    assert page["dedup_key"].endswith("-id1")


def test_labels_and_spans(spark):
    texts = ['[{"type":"x"},{"type":"create_alert","labels":{"a":"1"}}]', "nope", None, "[]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in frame.select(rule_labels(F.col("t"))).collect()]
    assert got == [{"a": "1"}, {}, {}, {}]
    assert [span_text(ms) for ms in (90_000, 86_400_000, 1_500)] == [
        "00:01:30", "1.00:00:00", "00:00:01.5000000"]


def test_match_columns_are_stable(make_events, rules_of):
    rules = rules_of(rule("a"), rule("b", "Temporal", window(60, 1)), rule("c", "Sequence", steps=["a"]))
    assert evaluate(make_events({}), rules).columns == MATCH_COLUMNS
