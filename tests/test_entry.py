"""The driver contract, and a sample of the questions against their reference SQL."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("daily_usage", "totals", "prompt_model_attribution", "following_tools", "idempotent_merge",
          "redacted_prompts", "classifications", "contexts", "daily_rollups", "session_list",
          "folded_projects", "transcript_events", "period_over_period", "export_rows")


def test_every_sql_belongs_to_a_question():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 140


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_question_agrees_with_sql(spark, name):
    ok, message, _ = compare(spark, connect(SMALL), name, entry.queries()[name],
                             entry.oracle_sql()[name], SMALL)
    assert ok, message
