"""The registered queries: a sample against SQL at the smallest scale, and basic shape."""

import pytest

from oracle_compare import compare, duck

import __spark_entry__ as registry

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["agent_activity_hourly", "agent_risk_summary", "session_timeline", "evaluate",
          "tool_anomalies", "alert_view", "json_contains", "throughput_windows"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    build, sql = registry.queries()[name], registry.oracle_sql()[name]
    assert compare(spark, duck(SMALL), build, sql, SMALL) is None


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(registry.queries())
    assert registry.entry(spark).count() > 0
