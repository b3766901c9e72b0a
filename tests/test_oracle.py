"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__
from runmend.plans import queries
from runmend.plans.oracle import ORACLE
from runmend.plans.queries import REGISTERED as QUERIES
from runmend.settings import Settings
from tests.oracle_compare import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["job_id", "run_id", "error_message", "start_time"]
    assert rows.count() == 7


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    assert compare(spark, db, QUERIES[name], ORACLE[name], SF_DIR) > 0


@pytest.mark.parametrize("name", [
    "monitored_runs", "error_text", "detect_new_failures", "detect_monitored_failures",
    "classify_dedup", "newer_success", "plan_retries", "check_outcomes", "notify_owner"])
def test_same_rows_without_broadcast(spark, db, name, monkeypatch):
    """The plans beyond the broadcast bound: salted joins and spread texts."""
    monkeypatch.setattr(queries, "SETTINGS", Settings(broadcast_rows=0, hot_rows=100))
    assert compare(spark, db, QUERIES[name], ORACLE[name], SF_DIR) > 0


# Rows at sf0.01, as calibrated in FIXTURES.md.
COUNTS = {
    ("runs_scan", ""): 10000,
    ("failed_runs", ""): 4896,
    ("detect_classify_decide", "classification = 'Transient'"): 17,
    ("detect_classify_decide", "classification = 'Permanent'"): 26,
    ("detect_classify_decide", "classification = 'Unknown'"): 36,
    ("plan_retries", "action = 'resolved'"): 432,
    ("plan_retries", "action = 'retry'"): 10,
    ("plan_retries", "action = 'skip_in_progress'"): 9,
    ("check_outcomes", "status = 'resolved'"): 128,
    ("check_outcomes", "status = 'max_retries_reached'"): 151,
    ("check_outcomes", "status = 'permanent_no_action'"): 66,
}


@pytest.mark.parametrize("name,condition", sorted(COUNTS))
def test_calibrated_counts(spark, name, condition):
    rows = QUERIES[name](spark, SF_DIR)
    assert rows.where(condition or "true").count() == COUNTS[name, condition]
