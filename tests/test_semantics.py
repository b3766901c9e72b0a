"""Boundary cases of the operators, one hand-made row each."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runmend import fixed, schemas
from runmend.operators import detect, incidents as state, notify, outcomes, reports, retry, runs as run_ops
from runmend.settings import Settings

NOW = datetime(2024, 5, 2, 12)
MICRO, MILLI, MINUTE = timedelta(microseconds=1), timedelta(milliseconds=1), timedelta(minutes=1)


def runs_table(spark, rows):
    """Rows of (job, run, start, result) or (job, run, start, result, state)."""
    full = [(r[0], r[1], r[2], r[4] if len(r) > 4 else "TERMINATED", r[3], [(f"t{r[1]}",)]) for r in rows]
    return spark.createDataFrame(full, schemas.RUNS)


def incident(tracking_id, job="j", status="retry_scheduled", failed=NOW - 60 * MINUTE,
             updated=NOW - 30 * MINUTE, latest=None, retries=0, history="own", version=2):
    latest = latest or tracking_id
    ids = sorted({tracking_id, latest}) if history == "own" else history
    return (tracking_id, job, tracking_id, latest, "text", "Transient", retries, status, failed,
            updated, ids, None, None, version)


def incidents_table(spark, rows):
    return spark.createDataFrame(rows, schemas.INCIDENTS)


def no_known(spark):
    return spark.createDataFrame([], "run_id string")


def no_outputs(spark):
    return spark.createDataFrame([], schemas.RUN_OUTPUTS)


def ids(df, column="run_id"):
    return {r[column] for r in df.select(column).collect()}


def test_lookback_is_inclusive_to_the_millisecond(spark):
    edge = NOW - timedelta(hours=24)
    runs = runs_table(spark, [
        ("a", "at", edge, "FAILED"), ("b", "before", edge - MILLI, "FAILED"), ("c", "after", edge + MILLI, "FAILED")])
    found = detect.detect_new_failures(runs, no_outputs(spark), no_known(spark), NOW)
    assert ids(found) == {"at", "after"}


def test_cap_counts_runs_of_every_state(spark):
    rows = [("a", f"ok{i}", NOW - i * MINUTE, "SUCCESS") for i in range(1, 6)]
    rows += [("a", "sixth", NOW - 6 * MINUTE, "FAILED")]
    rows += [("b", f"x{i}", NOW - i * MINUTE, "TIMEDOUT") for i in range(1, 5)]
    rows += [("b", "fifth", NOW - 6 * MINUTE, "FAILED")]
    runs = runs_table(spark, rows)
    assert ids(detect.detect_new_failures(runs, no_outputs(spark), no_known(spark), NOW)) == {"fifth"}
    uncapped = Settings(runs_per_job=None)
    assert ids(detect.detect_new_failures(
        runs, no_outputs(spark), no_known(spark), NOW, uncapped)) == {"fifth", "sixth"}


def test_tracked_runs_of_odd_histories(spark):
    rows = [incident("n", history=None), incident("e", history=[]),
            incident("d", history=["a", "a"]), incident("t", history=["a", "b"])]
    table = incidents_table(spark, rows)
    assert sorted(r.run_id for r in detect.known_run_ids(table).collect()) == ["a", "b"]
    runs = runs_table(spark, [("j", r, NOW, "FAILED") for r in ("a", "b", "c")])
    assert ids(detect.untracked(runs, detect.tracked_runs(table))) == {"c"}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_error_texts(spark, broadcast_rows):
    odd = ['quote \' and "', "back\\slash", "{braces} %s", "two\nlines", "Größe 漢字 🙂", " "]
    runs = spark.createDataFrame(
        [("j", f"r{i}", NOW, "TERMINATED", "FAILED", [(f"t{i}",)]) for i in range(len(odd))]
        + [("j", "null", NOW, "TERMINATED", "FAILED", [("tn",)]), ("j", "empty", NOW, "TERMINATED", "FAILED", [("te",)]),
           ("j", "none", NOW, "TERMINATED", "FAILED", []), ("j", "no_list", NOW, "TERMINATED", "FAILED", None),
           ("j", "no_row", NOW, "TERMINATED", "FAILED", [("tx",)]),
           ("j", "second", NOW, "TERMINATED", "FAILED", [("te",), ("t0",)])], schemas.RUNS)
    outputs = spark.createDataFrame(
        [(f"t{i}", text, None) for i, text in enumerate(odd)]
        + [("tn", None, None), ("te", "", None), ("no_list", "not a task", None)], schemas.RUN_OUTPUTS)
    settings = Settings(runs_per_job=None, broadcast_rows=broadcast_rows)
    found = detect.detect_new_failures(runs, outputs, no_known(spark), NOW, settings)
    texts = {r.run_id: r.error_message for r in found.collect()}
    assert [texts[f"r{i}"] for i in range(len(odd))] == odd
    for run in ("null", "empty", "none", "no_list", "no_row", "second"):
        assert texts[run] == fixed.NO_ERROR_TEXT


def test_monitored_jobs_may_repeat(spark):
    runs = runs_table(spark, [("a", "1", NOW, "FAILED"), ("b", "2", NOW, "FAILED")])
    monitored = spark.createDataFrame([("a",), ("a",), ("z",)], schemas.MONITORED_JOBS)
    for bound in (0, 10):
        found = detect.detect_new_failures(
            runs, no_outputs(spark), no_known(spark), NOW, Settings(broadcast_rows=bound), monitored)
        assert [r.run_id for r in found.collect()] == ["1"]


def test_due_is_inclusive(spark):
    delay = 15 * MINUTE
    table = incidents_table(spark, [
        incident("exactly", updated=NOW - delay), incident("early", updated=NOW - delay + MICRO),
        incident("other", status="retried", updated=NOW - 2 * delay)])
    assert ids(retry.due_rows(table, NOW), "tracking_id") == {"exactly"}


def test_due_by_recorded_time(spark):
    table = incidents_table(spark, [incident("now"), incident("later"), incident("never")])
    at = F.when(F.col("tracking_id") == "now", F.lit(NOW)).when(
        F.col("tracking_id") == "later", F.lit(NOW + MICRO))
    table = table.withColumn("next_retry_at", at)
    # A row without a recorded time goes by the delay, which has passed here.
    assert ids(retry.due_rows_by_time(table, NOW), "tracking_id") == {"now", "never"}
    assert ids(retry.due_rows_by_time(table.withColumn("last_updated_at", F.lit(NOW)), NOW), "tracking_id") == {"now"}


def actions(plan):
    return {r.tracking_id: r.action for r in plan.collect()}


@pytest.mark.parametrize("bound", [0, 1000])
def test_newer_success_is_strict_in_milliseconds(spark, bound):
    failed = NOW - 60 * MINUTE
    table = incidents_table(spark, [
        incident(name, job=name, failed=failed) for name in ("same", "within", "next", "older", "hidden", "none")])
    rows = [("same", "1", failed, "SUCCESS"), ("within", "2", failed + MILLI - MICRO, "SUCCESS"),
            ("next", "3", failed + MILLI, "SUCCESS"), ("older", "4", failed - MILLI, "SUCCESS"),
            ("hidden", "5", failed + MINUTE, "SUCCESS")]
    rows += [("hidden", f"h{i}", failed + (i + 2) * MINUTE, "CANCELED") for i in range(10)]
    plan = retry.plan_retries(table, runs_table(spark, rows), NOW, Settings(broadcast_rows=bound))
    assert actions(plan) == {
        "same": "retry", "within": "retry", "next": "resolved", "older": "retry",
        "hidden": "retry", "none": "retry"}


@pytest.mark.parametrize("bound", [0, 1000])
def test_due_rows_of_one_job(spark, bound):
    failed = NOW - 60 * MINUTE
    table = incidents_table(spark, [
        # both clear, at the same time: the smaller id goes first
        incident("c2", job="clear", failed=failed), incident("c1", job="clear", failed=failed),
        # the older one is resolved, the newer one is not
        incident("m1", job="mixed", failed=failed), incident("m2", job="mixed", failed=failed + 10 * MINUTE),
        incident("m3", job="mixed", failed=failed + 11 * MINUTE),
        # the one that failed first is not due, so it does not block
        incident("d1", job="due", failed=failed, updated=NOW), incident("d2", job="due", failed=failed + MINUTE),
        # a run is pending; success wins over it for the older one
        incident("p1", job="pending", failed=failed), incident("p2", job="pending", failed=failed + 10 * MINUTE)])
    runs = runs_table(spark, [
        ("mixed", "1", failed + 5 * MINUTE, "SUCCESS"), ("pending", "2", failed + 5 * MINUTE, "SUCCESS"),
        ("pending", "3", failed + 20 * MINUTE, None, "PENDING")])
    plan = retry.plan_retries(table, runs, NOW, Settings(broadcast_rows=bound))
    assert actions(plan) == {
        "c1": "retry", "c2": "skip_same_pass", "m1": "resolved", "m2": "retry", "m3": "skip_same_pass",
        "d1": "not_due", "d2": "retry", "p1": "resolved", "p2": "skip_in_progress"}


@pytest.mark.parametrize("bound", [0, 1000])
def test_active_run_older_than_every_failure(spark, bound):
    failed = NOW - 60 * MINUTE
    table = incidents_table(spark, [incident(name, job=name, failed=failed) for name in ("ninth", "tenth", "done")])
    rows = [("ninth", "n", failed - 50 * MINUTE, None, "RUNNING"), ("tenth", "t", failed - 50 * MINUTE, None, "RUNNING"),
            ("done", "d", failed - 50 * MINUTE, "SUCCESS"), ("other", "o", failed - 50 * MINUTE, None, "RUNNING")]
    for job, newer in (("ninth", 9), ("tenth", 10)):
        # Some of the newer runs are older than the failure, too.
        rows += [(job, f"{job}{i}", failed + (i - 5) * MINUTE, "FAILED") for i in range(newer)]
    plan = retry.plan_retries(table, runs_table(spark, rows), NOW, Settings(broadcast_rows=bound))
    assert actions(plan) == {"ninth": "skip_in_progress", "tenth": "retry", "done": "retry"}


def test_tables_partitioned_by_day(spark, tmp_path):
    rows = [("a", f"r{day}", NOW - timedelta(days=day), "FAILED") for day in range(5)]
    rows += [("a", "ok", NOW - timedelta(days=3), "SUCCESS")]
    runs = runs_table(spark, rows)
    outputs = runs.selectExpr("tasks[0].run_id AS task_run_id", "concat('Access denied ', run_id) AS error",
                              "string(null) AS error_trace", "to_date(start_time) AS run_date")
    runs.selectExpr("*", "to_date(start_time) AS run_date").write.partitionBy("run_date").parquet(str(tmp_path / "runs"))
    outputs.write.partitionBy("run_date").parquet(str(tmp_path / "outputs"))
    stored, texts = spark.read.parquet(str(tmp_path / "runs")), spark.read.parquet(str(tmp_path / "outputs"))

    found = detect.detect_new_failures(stored, texts, no_known(spark), NOW)
    assert {r.run_id: r.error_message for r in found.collect()} == {
        "r0": "Access denied r0", "r1": "Access denied r1"}
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "FileScan" in line]
    assert scans and all("run_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)

    table = incidents_table(spark, [
        incident("x", job="a", failed=NOW - timedelta(days=4)), incident("y", job="a", failed=NOW - timedelta(days=2)),
        incident("z", job="a", status="retried", latest="r2", retries=1, failed=NOW - timedelta(days=2, hours=1))])
    assert actions(retry.plan_retries(table, stored, NOW)) == {"x": "resolved", "y": "retry"}
    (outcome,) = outcomes.check_outcomes(table, stored, texts).collect()
    assert outcome.error_message == "Access denied r2"


def test_requests_are_named_by_attempt(spark):
    table = incidents_table(spark, [incident("x", retries=1)])
    runs = runs_table(spark, [])
    first = retry.retry_requests(retry.plan_retries(table, runs, NOW), F.lit(NOW)).collect()
    again = retry.retry_requests(
        retry.plan_retries(table, runs, NOW + MINUTE), F.lit(NOW + MINUTE)).collect()
    assert first[0].request_id == again[0].request_id
    more = retry.retry_requests(retry.plan_retries(
        table.withColumn("retry_count", F.lit(2)), runs, NOW), F.lit(NOW)).collect()
    assert more[0].request_id != first[0].request_id


def test_acks(spark):
    table = incidents_table(spark, [
        incident("fresh"), incident("old", history=["old", "r1"], latest="r1"),
        incident("bare", history=None, latest="b1"), incident("done", status="resolved"), incident("two")])
    acks = spark.createDataFrame(
        [("fresh", "n1"), ("old", "r1"), ("bare", "b2"), ("done", "n2"), ("two", "z2"), ("two", "z1"),
         ("stranger", "n3")], schemas.RETRY_ACKS)
    rows = {r.tracking_id: r for r in retry.apply_retry_acks(table, acks).collect()}
    assert set(rows) == {"fresh", "bare", "two"}
    assert rows["fresh"].all_run_ids == ["fresh", "n1"] and rows["fresh"].retry_count == 1
    assert rows["bare"].all_run_ids == ["bare", "b1", "b2"]  # a null history is not lost
    assert rows["two"].latest_run_id == "z1"


@pytest.mark.parametrize("bound", [0, 1000])
def test_outcomes(spark, bound):
    def retried(name, run, count=1):
        return incident(name, status="retried", latest=run, retries=count)

    table = incidents_table(spark, [
        retried("running", "r1"), retried("missing", "r2"), retried("ok", "r3"), retried("failed", "r4"),
        retried("cancelled", "r5"), retried("timed", "r6"), retried("two", "r4", 2), retried("three", "r4", 3),
        retried("four", "r4", 4), retried("ok_at_three", "r3", 3), incident("waiting")])
    runs = runs_table(spark, [
        ("j", "r1", NOW, None, "RUNNING"), ("j", "r3", NOW, "SUCCESS"), ("j", "r4", NOW, "FAILED"),
        ("j", "r5", NOW, "CANCELED"), ("j", "r6", NOW, "TIMEDOUT")])
    outputs = spark.createDataFrame(
        [("tr4", "Read timed out", None), ("tr5", "Access denied", None)], schemas.RUN_OUTPUTS)
    rows = outcomes.check_outcomes(table, runs, outputs, Settings(broadcast_rows=bound)).collect()
    assert {r.tracking_id: r.status for r in rows} == {
        "running": "still_running", "missing": "still_running", "ok": "resolved", "failed": "retry_scheduled",
        "cancelled": "permanent_no_action", "timed": "unknown_flagged", "two": "retry_scheduled",
        "three": "max_retries_reached", "four": "max_retries_reached", "ok_at_three": "resolved"}
    texts = {r.tracking_id: (r.error_message, r.classification) for r in rows}
    assert texts["timed"] == (fixed.NO_ERROR_TEXT, "Unknown")
    assert texts["three"] == texts["ok"] == (None, None)


def test_invalid_events_and_merge(spark):
    events = spark.createDataFrame(
        [("a", "1", "text", None), ("a", "2", "", NOW), (None, "3", "text", NOW), ("", "4", "text", NOW),
         ("a", "5", "text", NOW - MINUTE), ("a", "5", "later", NOW)], schemas.FAILURE_EVENTS)
    reported = detect.event_failures(events, F.lit(NOW))
    assert {(r.run_id, r.start_time) for r in reported.collect()} == {
        ("1", NOW), ("5", NOW - MINUTE), ("5", NOW)}
    scanned = reported.limit(0).unionByName(spark.createDataFrame(
        [("a", "5", "scanned", NOW - 9 * MINUTE), ("b", "6", "scanned", NOW)], reported.schema))
    merged = {r.run_id: r.error_message for r in detect.merge_failures(reported, scanned).collect()}
    assert merged == {"1": "text", "5": "text", "6": "scanned"}


def log_of(spark, rows):
    """Rows of (tracking, seq, event, run, status)."""
    return spark.createDataFrame(
        [(t, s, e, NOW + s * MINUTE, "j", r, NOW if e == "detected" else None, "text", None, st,
          None, None, None, None, None, None) for t, s, e, r, st in rows], schemas.INCIDENT_EVENTS)


HISTORY = [
    ("x", 1, "detected", "0", "detected"), ("x", 2, "classified", "0", "retry_scheduled"),
    ("x", 3, "retried", "9", "retried"), ("x", 4, "classified", "9", "retry_scheduled"),
    ("x", 5, "retried", "1", "retried"), ("x", 6, "resolved", None, "resolved")]


def test_state_from_events_in_any_order_and_repeated(spark):
    shuffled = HISTORY[::-1] + HISTORY[2:4]
    (row,) = state.current_state(log_of(spark, shuffled)).collect()
    assert row.all_run_ids == ["0", "9", "1"] and row.latest_run_id == "1"
    assert (row.retry_count, row.status, row.version) == (2, "resolved", 6)
    assert (row.first_failed_at, row.last_updated_at) == (NOW, NOW + 6 * MINUTE)


@pytest.mark.parametrize("small", [False, True])
def test_folding_in_parts_equals_folding_at_once(spark, small):
    other = [("y", 1, "detected", "y0", "detected")]
    whole = {r.tracking_id: r for r in state.current_state(log_of(spark, HISTORY + other)).collect()}
    for cut in (2, 3, 5):
        base = state.current_state(log_of(spark, HISTORY[:cut]))
        # The first event after the cut, and one before it, arrive again.
        rest = log_of(spark, HISTORY[cut - 1:] + other + HISTORY[:1])
        parts = {r.tracking_id: r for r in state.apply_updates(base, rest, small).collect()}
        assert parts == whole


def test_update_of_a_row_that_was_never_backfilled(spark):
    base = incidents_table(spark, [incident("x", latest="x1", history=None)])
    later = log_of(spark, [("x", 3, "retried", "x2", "retried")])
    (row,) = state.apply_updates(base, later).collect()
    assert row.all_run_ids == ["x", "x1", "x2"] and row.retry_count == 1
    assert state.backfill_run_ids(base).first().all_run_ids == ["x", "x1"]


def test_storing_a_fix_keeps_status_and_time(spark):
    base = state.current_state(log_of(spark, HISTORY[:2]))
    fixes = base.select("tracking_id", "job_id", "version", "status", F.lit("{}").alias("fix_suggestion"))
    log = log_of(spark, HISTORY[:2]).unionByName(state.store_fix_events(fixes, NOW + timedelta(days=1)))
    (row,) = state.current_state(log).collect()
    assert row.fix_suggestion == "{}" and row.status == "retry_scheduled"
    assert row.last_updated_at == NOW + 2 * MINUTE
    following = log.unionByName(log_of(spark, [("x", 4, "retried", "9", "retried")]))
    assert reports.illegal_transitions(following).count() == 0


def test_first_failed_at_basis(spark):
    found = spark.createDataFrame([("j", "r", "text", NOW - MINUTE)], "job_id string, run_id string, error_message string, start_time timestamp")
    by_run = state.insert_incidents(found, NOW).first()
    by_pass = state.insert_incidents(found, NOW, Settings(first_failed_basis="detection")).first()
    assert (by_run.first_failed_at, by_pass.first_failed_at) == (NOW - MINUTE, NOW)
    assert by_run.tracking_id == by_pass.tracking_id


def test_reports(spark):
    table = incidents_table(spark, [
        incident("a", failed=NOW), incident("b", failed=NOW), incident("c", failed=NOW - MINUTE, status="unknown_flagged"),
        incident("d", job="k", status="max_retries_reached", failed=NOW - 2 * MINUTE)])
    assert [r.tracking_id for r in reports.recent_incidents(table, 3).collect()] == ["b", "a", "c"]
    assert [r.tracking_id for r in reports.job_history(table, "j").collect()] == ["b", "a", "c"]
    assert ids(reports.escalations(table), "tracking_id") == {"d"}
    assert ids(reports.review_queue(table), "tracking_id") == {"c"}
    assert reports.incident_by_id(table, "d").first().status == "max_retries_reached"
    tags = spark.createDataFrame([("k", "x"), ("k", "y"), ("j", "z")], "job_id string, tag string")
    assert ids(run_ops.tagged_jobs(tags, ["x", "y"]), "job_id") == {"k"}


def test_illegal_changes_and_gaps(spark):
    log = log_of(spark, [
        ("ok", 1, "detected", "0", "detected"), ("ok", 2, "classified", "0", "unknown_flagged"),
        ("start", 1, "classified", "0", "retry_scheduled"),
        ("gap", 1, "detected", "0", "detected"), ("gap", 3, "retried", "1", "retried"),
        ("reopen", 1, "detected", "0", "detected"), ("reopen", 2, "classified", "0", "permanent_no_action"),
        ("reopen", 3, "retried", "1", "retried")])
    found = {(r.tracking_id, r.seq, r.from_status) for r in reports.illegal_transitions(log).collect()}
    assert found == {("start", 1, None), ("gap", 3, None), ("reopen", 3, "permanent_no_action")}


def test_required_columns_and_evolution(spark):
    with pytest.raises(ValueError, match="version"):
        schemas.conform(incidents_table(spark, []).drop("version"), schemas.INCIDENTS)
    old = incidents_table(spark, [incident("x")]).drop("next_retry_at", "fix_suggestion")
    new = schemas.evolve(old, schemas.INCIDENTS)
    assert set(new.columns) == set(schemas.INCIDENTS.names) and new.first().fix_suggestion is None
    assert schemas.evolve(new, schemas.INCIDENTS).columns == new.columns


def test_owners_beyond_the_bound_are_not_sent_through_the_driver(spark, tmp_path):
    """The pieces of a dimension are many rows, whatever Spark's estimate of them is."""
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None), ("4", "z")], "tracking_id string, job_id string")
    jobs = spark.createDataFrame([("a", "ann"), ("b", None), (None, "nobody")], "job_id string, creator_user_name string")
    jobs.write.parquet(f"{tmp_path}/jobs")
    found = notify.with_owner(rows, spark.read.parquet(f"{tmp_path}/jobs"), Settings(broadcast_rows=0, default_owner="none"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.tracking_id, r.owner) for r in found.collect()) == [("1", "ann"), ("2", "ann"), ("3", "none"), ("4", "none")]
