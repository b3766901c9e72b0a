"""The registered queries: every operator over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend import fixed, schemas
from runmend.functions import strict_json
from runmend.functions.clock import instant
from runmend.functions.labels import with_rule_label
from runmend.functions.messages import notice_time
from runmend.functions.prompts import classification_prompt, fix_prompt
from runmend.operators import classify, detect, fixes, incidents as state, joins, notify
from runmend.operators import outcomes, reports, retry, runs as run_ops
from runmend.plans.cycle import Inputs, Judgement, run_cycle as run_one_cycle, run_retries as run_only_retries
from runmend.session import scratch_path
from runmend.settings import Settings
from runmend.sources import sample_tables as sample
from runmend.sources.sample_tables import AS_OF
from runmend.sources.store import Batch, TriageStore
from runmend.sources.tables import stream_table, written
from runmend.streaming.reactor import react_to_runs, scan_runs_table, take_events
from runmend.streaming.timeline import runs_from_timeline_stream

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings()
REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def _now() -> Column:
    return sample.ntz(AS_OF)


def _joined(column: str) -> Column:
    """A list of strings as one string, which every engine prints the same way."""
    return F.array_join(column, ",").alias(column)


# --- scans, filters, per-job summaries ------------------------------------------


@query
def runs_scan(spark, sf_dir):
    return run_ops.scan_runs(sample.runs(spark, sf_dir))


@query
def latest_runs_per_job(spark, sf_dir):
    runs = run_ops.newest_per_job(sample.runs(spark, sf_dir), SETTINGS.runs_per_job)
    return runs.select(*run_ops.STATE_COLUMNS)


@query
def recent_runs_top10(spark, sf_dir):
    runs = run_ops.newest_per_job(sample.runs(spark, sf_dir), SETTINGS.safety_runs_per_job)
    return runs.select(*run_ops.STATE_COLUMNS)


@query
def failed_runs(spark, sf_dir):
    return run_ops.failed_runs(sample.runs(spark, sf_dir)).select(*run_ops.STATE_COLUMNS)


@query
def lookback(spark, sf_dir):
    runs = run_ops.within_lookback(sample.runs(spark, sf_dir), AS_OF, SETTINGS)
    return runs.select(*run_ops.STATE_COLUMNS)


@query
def last_success_per_job(spark, sf_dir):
    return run_ops.last_success_per_job(sample.runs(spark, sf_dir), SETTINGS)


@query
def in_progress_jobs(spark, sf_dir):
    return run_ops.jobs_in_progress(sample.runs(spark, sf_dir), SETTINGS)


@query
def latest_run_status(spark, sf_dir):
    return run_ops.latest_run_status(sample.runs(spark, sf_dir))


@query
def monitored_runs(spark, sf_dir):
    monitored = sample.monitored_jobs(spark, sf_dir)
    small = joins.is_small(monitored, SETTINGS)
    runs = run_ops.monitored_runs(sample.runs(spark, sf_dir), monitored, small)
    return runs.select(*run_ops.STATE_COLUMNS)


@query
def monitored_by_tag(spark, sf_dir):
    tagged = run_ops.tagged_jobs(sample.job_tags(spark, sf_dir), ["BUILDING", "FURNITURE"])
    small = joins.is_small(tagged, SETTINGS)
    runs = run_ops.monitored_runs(sample.runs(spark, sf_dir), tagged, small)
    return runs.select("job_id", "run_id", "result_state")


# --- detection -------------------------------------------------------------------


@query
def known_run_ids(spark, sf_dir):
    return detect.known_run_ids(sample.incidents(spark, sf_dir))


@query
def untracked_runs(spark, sf_dir):
    runs = sample.runs(spark, sf_dir).select(*run_ops.STATE_COLUMNS)
    return detect.untracked(runs, _tracked(spark, sf_dir)).select(*run_ops.STATE_COLUMNS)


@query
def error_text(spark, sf_dir):
    failed = run_ops.failed_runs(run_ops.scan_runs(sample.runs(spark, sf_dir)))
    small = joins.is_small(failed, SETTINGS)
    found = detect.with_error_text(failed, sample.run_outputs(spark, sf_dir), SETTINGS, small)
    return found.select("run_id", "task_run_id", "error_message")


def _tracked(spark, sf_dir):
    return detect.tracked_runs(sample.incidents(spark, sf_dir))


def _detected(spark, sf_dir):
    return detect.detect_new_failures(
        sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir),
        _tracked(spark, sf_dir), AS_OF, SETTINGS)


@query
def detect_new_failures(spark, sf_dir):
    return _detected(spark, sf_dir)


@query
def detect_monitored_failures(spark, sf_dir):
    return detect.detect_new_failures(
        sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir),
        _tracked(spark, sf_dir), AS_OF, SETTINGS, sample.monitored_jobs(spark, sf_dir))


@query
def detect_uncapped(spark, sf_dir):
    return detect.detect_new_failures(
        sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir),
        _tracked(spark, sf_dir), AS_OF, Settings(runs_per_job=None))


@query
def valid_events(spark, sf_dir):
    events = sample.failure_events(spark, sf_dir)
    return events.select(
        "run_id", F.when(detect.is_valid_event(), "event").otherwise("scan").alias("mode"))


@query
def merged_failures(spark, sf_dir):
    from_events = detect.event_failures(sample.failure_events(spark, sf_dir), _now())
    return detect.merge_failures(from_events, _detected(spark, sf_dir))


# --- labels ----------------------------------------------------------------------


def _failed_with_text(spark, sf_dir):
    runs = run_ops.failed_runs(sample.runs(spark, sf_dir))
    text = detect.error_text(F.col("raw_error"), SETTINGS)
    return runs.withColumn("error_message", text).select(
        "job_id", "run_id", "start_time", "error_message", "raw_error", "k")


@query
def classify_rules(spark, sf_dir):
    rows = _failed_with_text(spark, sf_dir).select("run_id", "error_message")
    return classify.classify_by_rules(rows).drop("raw_response")


@query
def classify_dedup(spark, sf_dir):
    rows = _failed_with_text(spark, sf_dir).select("run_id", "error_message")
    return classify.classify_dedup(rows, SETTINGS).select(
        "run_id", "error_message", "classification", "confidence")


@query
def decide_status(spark, sf_dir):
    rows = _failed_with_text(spark, sf_dir)
    return classify.decide(with_rule_label(rows, "error_message", only_classification=True)).select(
        "run_id", "classification", "status")


@query
def label_confusion(spark, sf_dir):
    """Rows whose text is one of the labelled errors, which are few at any scale."""
    expected = spark.createDataFrame(
        list(sample.ERRORS.values()), "error_message string, expected string")
    rows = classify.classify_by_rules(_failed_with_text(spark, sf_dir))
    return reports.label_confusion(rows.join(F.broadcast(expected), "error_message"))


@query
def build_prompt(spark, sf_dir):
    rows = _failed_with_text(spark, sf_dir)
    prompt = classification_prompt(F.col("error_message"))
    return rows.select("run_id", prompt.alias("prompt"))


@query
def build_fix_prompt(spark, sf_dir):
    rows = _failed_with_text(spark, sf_dir)
    reasoning = F.when(F.col("k") % 2 == 0, F.concat(F.lit("seen in {run} "), F.col("run_id")))
    job_id = F.when(F.col("k") % 3 != 0, F.col("job_id")).otherwise("")
    return rows.select("run_id", fix_prompt(F.col("error_message"), job_id, reasoning).alias("prompt"))


@query
def parse_response(spark, sf_dir):
    parsed = strict_json.parse_response(F.col("raw_response"))
    return sample.model_calls(spark, sf_dir).select("run_id", parsed.alias("p")).select(
        "run_id", "p.classification", "p.reasoning", "p.confidence", "p.parse_status")


@query
def parse_status_counts(spark, sf_dir):
    parsed = strict_json.parse_response(F.col("raw_response"))
    rows = sample.model_calls(spark, sf_dir).select(parsed["parse_status"].alias("parse_status"))
    return reports.parse_status_counts(rows)


@query
def parse_fix(spark, sf_dir):
    """Fix responses: whole, without a field, unreadable, and calls that failed."""
    k = F.col("k")
    raw = (
        F.when(k % 4 == 0, F.concat(
            F.lit('{"root_cause": "cause '), F.col("run_id"),
            F.lit('", "fix_steps": ["first", "second"], "prevention": "watch"}')))
        .when(k % 4 == 1, F.lit('{"root_cause": null, "prevention": "watch"}'))
        .when(k % 4 == 2, F.lit("no JSON here")))
    call_error = F.when(k % 4 == 3, F.lit("timed out"))
    reasoning = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("because of "), F.col("run_id")))
    fix = strict_json.parse_fix(raw, reasoning, call_error)
    return _failed_with_text(spark, sf_dir).select("run_id", fix.alias("f")).select(
        "run_id", "f.root_cause", F.array_join("f.fix_steps", "|").alias("fix_steps"), "f.prevention")


@query
def model_usage(spark, sf_dir):
    calls = sample.model_calls(spark, sf_dir)
    return reports.model_usage(
        calls.withColumn("prompt", classification_prompt(F.col("error_message"))))


# --- incident state ----------------------------------------------------------------


@query
def rows_by_status(spark, sf_dir):
    rows = state.rows_by_status(sample.incidents(spark, sf_dir), fixed.RETRY_SCHEDULED)
    return rows.select("tracking_id", "job_id", "classification", "retry_count", "last_updated_at")


@query
def insert_incidents(spark, sf_dir):
    rows = state.insert_incidents(_detected(spark, sf_dir), AS_OF, SETTINGS)
    return rows.withColumn("all_run_ids", _joined("all_run_ids")).drop("version")


@query
def detect_classify_decide(spark, sf_dir):
    labelled = classify.decide(classify.classify_by_rules(_detected(spark, sf_dir)))
    return labelled.select(
        state.tracking_id(F.col("job_id"), F.col("run_id")).alias("tracking_id"),
        "job_id", "run_id", "error_message", "classification", "status")


@query
def new_incident_state(spark, sf_dir):
    moves = state.begin_tracking(_detected(spark, sf_dir), AS_OF, SETTINGS)
    rows = state.current_state(Judgement(SETTINGS).events(moves, AS_OF, with_fixes=True))
    return rows.select(
        "tracking_id", "job_id", "original_run_id", "latest_run_id", "error_message",
        "classification", "retry_count", "status", _joined("all_run_ids"))


@query
def current_state(spark, sf_dir):
    rows = state.current_state(sample.incident_log(spark, sf_dir))
    return rows.withColumn("all_run_ids", _joined("all_run_ids")).drop(
        "fix_suggestion", "requested_at", "run_started_at", "corrected_at")


@query
def run_history(spark, sf_dir):
    rows = state.current_state(sample.incident_log(spark, sf_dir))
    return rows.select("tracking_id", F.posexplode("all_run_ids").alias("pos", "run_id"))


@query
def apply_updates(spark, sf_dir):
    """The log folded in two parts: detection and labels first, retries on top."""
    log = sample.incident_log(spark, sf_dir)
    base = state.current_state(log.where(F.col("seq") <= 2))
    rows = state.apply_updates(base, log.where(F.col("seq") > 2))
    return rows.select(
        "tracking_id", "latest_run_id", "classification", "retry_count", "status",
        "last_updated_at", _joined("all_run_ids"), "version")


@query
def evolve_schema(spark, sf_dir):
    rows = schemas.evolve(sample.incidents(spark, sf_dir), schemas.INCIDENTS)
    return rows.select("tracking_id", "status", "next_retry_at", "fix_suggestion")


@query
def backfill_run_ids(spark, sf_dir):
    """Histories of permanent incidents are taken away and filled in again."""
    rows = sample.incidents(spark, sf_dir)
    emptied = F.when(F.col("status") != fixed.PERMANENT_NO_ACTION, F.col("all_run_ids"))
    filled = state.backfill_run_ids(rows.withColumn("all_run_ids", emptied))
    return filled.select("tracking_id", "original_run_id", "latest_run_id", _joined("all_run_ids"))


@query
def illegal_transitions(spark, sf_dir):
    return reports.illegal_transitions(sample.incident_log(spark, sf_dir))


# --- retries and outcomes ------------------------------------------------------------


@query
def due_rows(spark, sf_dir):
    rows = retry.due_rows(sample.incidents(spark, sf_dir), AS_OF, SETTINGS)
    waited = F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.col("last_updated_at").cast("timestamp"))
    return rows.select("tracking_id", "job_id", "last_updated_at", waited.alias("waited_micros"))


@query
def due_rows_v2(spark, sf_dir):
    rows = state.current_state(sample.incident_log(spark, sf_dir))
    return retry.due_rows_by_time(rows, AS_OF).select("tracking_id", "job_id", "next_retry_at")


@query
def newer_success(spark, sf_dir):
    rows = retry.newer_success(_incidents_table(spark, sf_dir), sample.runs(spark, sf_dir), SETTINGS)
    return rows.select("tracking_id", "job_id", "first_failed_at", "last_success_at")


def _incidents_table(spark, sf_dir):
    return written(sample.incidents(spark, sf_dir), "incidents")


def _plan(spark, sf_dir):
    return retry.plan_retries(
        _incidents_table(spark, sf_dir), sample.runs(spark, sf_dir), AS_OF, SETTINGS)


@query
def plan_retries(spark, sf_dir):
    return _plan(spark, sf_dir).select("tracking_id", "job_id", "action")


@query
def plan_retries_v2(spark, sf_dir):
    rows = written(state.current_state(sample.incident_log(spark, sf_dir)), "state")
    plan = retry.plan_retries(rows, sample.runs(spark, sf_dir), AS_OF, SETTINGS, by_time=True)
    return plan.select("tracking_id", "job_id", "action")


@query
def retry_requests(spark, sf_dir):
    return retry.retry_requests(_plan(spark, sf_dir), _now())


@query
def apply_retry_acks(spark, sf_dir):
    rows = retry.apply_retry_acks(
        sample.incidents(spark, sf_dir), sample.retry_acks(spark, sf_dir))
    return rows.select(
        "tracking_id", "latest_run_id", "retry_count", "status", _joined("all_run_ids"))


@query
def check_outcomes(spark, sf_dir):
    rows = outcomes.check_outcomes(
        sample.incidents(spark, sf_dir), sample.runs(spark, sf_dir),
        sample.run_outputs(spark, sf_dir), SETTINGS)
    return rows.select(
        "tracking_id", "job_id", "run_id", "retry_count", "error_message", "classification", "status")


# --- fixes and notices ------------------------------------------------------------------


def _permanent(spark, sf_dir):
    rows = state.rows_by_status(sample.incidents(spark, sf_dir), fixed.PERMANENT_NO_ACTION)
    rows = rows.select("tracking_id", "job_id", "status", "error_message", "first_failed_at")
    return fixes.suggest_by_rules()(classify.classify_by_rules(rows))


@query
def fix_suggestions(spark, sf_dir):
    return _permanent(spark, sf_dir).select(
        "tracking_id", "fix.root_cause", F.array_join("fix.fix_steps", "|").alias("fix_steps"),
        "fix.prevention")


@query
def store_fix(spark, sf_dir):
    """Fixes put on permanent incidents as JSON; the fields are read back from it."""
    with_fix = _permanent(spark, sf_dir).select(
        "tracking_id", "job_id", "status", F.lit(2).alias("version"),
        strict_json.fix_json(F.col("fix")).alias("fix_suggestion"))
    base = state.current_state(sample.incident_log(spark, sf_dir))
    rows = state.apply_updates(base, state.store_fix_events(with_fix, AS_OF))
    stored = F.from_json("fix_suggestion", schemas.FIX)
    updated = F.col("last_updated_at").cast("timestamp_ntz").alias("last_updated_at")
    return rows.select("tracking_id", "status", updated, stored.alias("f")).select(
        "tracking_id", "status", "last_updated_at", "f.root_cause", "f.prevention",
        F.size("f.fix_steps").alias("n_steps"))


@query
def notify_owner(spark, sf_dir):
    rows = notify.with_owner(sample.incidents(spark, sf_dir), sample.jobs(spark, sf_dir), SETTINGS)
    return rows.select("tracking_id", "job_id", "owner")


@query
def notifications(spark, sf_dir):
    rows = notify.with_owner(_permanent(spark, sf_dir), sample.jobs(spark, sf_dir), SETTINGS)
    sent = notify.notifications(rows, _now())
    fix = F.from_json("fix_suggestion", schemas.FIX)
    return sent.select(
        "job_id", "notified_user", "error_message", "ai_reasoning",
        fix["root_cause"].alias("root_cause"), "notification_time",
        notice_time(F.col("notification_time")).alias("sent_text"))


@query
def notification_body(spark, sf_dir):
    rows = notify.with_owner(_permanent(spark, sf_dir), sample.jobs(spark, sf_dir), SETTINGS)
    return notify.notice_bodies(rows, F.col("first_failed_at")).select("tracking_id", "body")


# --- reports ---------------------------------------------------------------------------


@query
def status_counts(spark, sf_dir):
    return reports.status_counts(sample.incidents(spark, sf_dir))


@query
def recent_incidents(spark, sf_dir):
    return reports.recent_incidents(sample.incidents(spark, sf_dir))


@query
def job_history(spark, sf_dir):
    return reports.job_history(sample.incidents(spark, sf_dir))


@query
def review_queue(spark, sf_dir):
    return reports.review_queue(sample.incidents(spark, sf_dir)).select(
        "tracking_id", "job_id", "error_message", "first_failed_at")


@query
def escalations(spark, sf_dir):
    """Incidents that the outcome check finds out of retries."""
    rows = outcomes.check_outcomes(
        sample.incidents(spark, sf_dir), sample.runs(spark, sf_dir),
        sample.run_outputs(spark, sf_dir), SETTINGS)
    return reports.escalations(rows).select("tracking_id", "job_id", "retry_count")


@query
def audit_report(spark, sf_dir):
    return reports.audit_report(sample.incidents(spark, sf_dir))


@query
def apply_corrections(spark, sf_dir):
    rows = reports.apply_corrections(
        sample.incidents(spark, sf_dir), sample.corrections(spark, sf_dir))
    return rows.select("tracking_id", "classification", "status")


# --- passes and streams ------------------------------------------------------------------


@query
def run_cycle(spark, sf_dir):
    """Two passes, 16 minutes apart, that start from an empty store."""
    store = TriageStore(spark, scratch_path(spark, "cycle"))
    inputs = Inputs(
        sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir), sample.jobs(spark, sf_dir))
    run_one_cycle(store, inputs, AS_OF, 1)
    run_one_cycle(store, inputs, AS_OF + timedelta(minutes=16), 2)
    requested = store.retry_requests().select("tracking_id", F.lit(True).alias("requested"))
    return store.state().join(requested, "tracking_id", "left").select(
        "job_id", "original_run_id", "classification", "status",
        F.coalesce("requested", F.lit(False)).alias("requested"))


def _event_stream(spark, sf_dir):
    return stream_table(spark, sf_dir, sample.SCHEMAS["events"], pathGlobFilter="events.parquet")


def _finish(writer):
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()


@query
def stream_runs(spark, sf_dir):
    """All runs read as a stream; the incidents it leaves."""
    store = TriageStore(spark, scratch_path(spark, "reactor"))
    _finish(react_to_runs(
        sample.runs_from_events(_event_stream(spark, sf_dir)),
        lambda: sample.run_outputs(spark, sf_dir), lambda: sample.jobs(spark, sf_dir),
        store, lambda number: AS_OF, f"{store.root}/checkpoint", only_recent=False))
    return store.state().select(
        "job_id", "original_run_id", "error_message", "classification", "status")


def _taken_events(spark, sf_dir):
    store = TriageStore(spark, scratch_path(spark, "intake"))
    events = sample.failure_events_from_runs(sample.runs_from_events(_event_stream(spark, sf_dir)))
    jobs = lambda: sample.jobs(spark, sf_dir)
    scan = scan_runs_table(
        lambda: sample.runs(spark, sf_dir), lambda: sample.run_outputs(spark, sf_dir), jobs, store,
        lambda number: AS_OF)
    _finish(take_events(
        events, jobs, store, lambda number: AS_OF, f"{store.root}/checkpoint", full_scan=scan))
    undated = F.col("first_failed_at") == instant(AS_OF, T.TimestampType())
    own_time = F.when(~undated, F.col("first_failed_at").cast("timestamp_ntz"))
    return store.state().select(
        "job_id", "original_run_id", "error_message", "classification", "status",
        undated.alias("undated"), own_time.alias("first_failed_at"),
        F.from_json("fix_suggestion", schemas.FIX)["root_cause"].alias("root_cause"))


@query
def stream_failure_events(spark, sf_dir):
    """All failure events read as a stream, and the incidents it leaves. An event that lacks a
    field starts a scan of the run table, so every failed run is there."""
    return _taken_events(spark, sf_dir)


@query
def stream_failure_events_scanned(spark, sf_dir):
    """The same under the name it had first."""
    return _taken_events(spark, sf_dir)


# --- runs as they come to be ---------------------------------------------------------------


@query
def timeline_runs(spark, sf_dir):
    """Runs out of a table of periods."""
    runs = run_ops.runs_from_timeline(sample.timeline(spark, sf_dir))
    return runs.select("job_id", "run_id", "start_time", "life_cycle_state", "result_state")


@query
def detect_from_timeline(spark, sf_dir):
    return detect.detect_new_failures(
        run_ops.runs_from_timeline(sample.timeline(spark, sf_dir)), sample.run_outputs(spark, sf_dir),
        _tracked(spark, sf_dir), AS_OF, SETTINGS)


@query
def latest_runs_tied(spark, sf_dir):
    """Equal start times go by the number of the run; repeated rows count once."""
    runs = run_ops.newest_per_job(sample.tied_runs(spark, sf_dir), SETTINGS.runs_per_job)
    return runs.select(*run_ops.STATE_COLUMNS)


def _merged_runs(spark, sf_dir):
    """The newest runs of each job after two looks at the run table. The second one reads the
    days since the first one, and those of runs that were active then."""
    first = written(run_ops.as_recent(sample.earlier_look(spark, sf_dir), sample.SEEN, SETTINGS), "look")
    changed = run_ops.changed_runs(sample.dated_runs(spark, sf_dir), first, sample.SEEN)
    second = written(run_ops.as_recent(changed, AS_OF, SETTINGS), "look")
    return run_ops.newest_versions(first.unionByName(second), SETTINGS)


@query
def recent_runs_merged(spark, sf_dir):
    return _merged_runs(spark, sf_dir).select(*run_ops.STATE_COLUMNS)


@query
def in_progress_merged(spark, sf_dir):
    return run_ops.jobs_in_progress(_merged_runs(spark, sf_dir), SETTINGS)


@query
def newer_success_merged(spark, sf_dir):
    rows = retry.newer_success(_incidents_table(spark, sf_dir), _merged_runs(spark, sf_dir), SETTINGS, ranked=True)
    return rows.select("tracking_id", "job_id", "first_failed_at", "last_success_at")


@query
def plan_retries_merged(spark, sf_dir):
    plan = retry.plan_retries(
        _incidents_table(spark, sf_dir), _merged_runs(spark, sf_dir), AS_OF, SETTINGS, ranked=True)
    return plan.select("tracking_id", "job_id", "action")


# --- the store -------------------------------------------------------------------------------


def _stored_log(spark, sf_dir, log, batches=4):
    """A store that took the log in several batches, by time, two of them folded."""
    store = TriageStore(spark, scratch_path(spark, "store"))
    log = written(log, "log")
    start, step = AS_OF - timedelta(days=32), timedelta(days=32) / batches
    for number in range(batches):
        of = (F.col("ts") >= sample.ntz(start + number * step)) & (F.col("ts") < sample.ntz(start + (number + 1) * step))
        store.append_events(log.where(of), Batch("history", number))
        if number == batches - 2:
            store.compact()
    return store


def _plain_time(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query
def store_state(spark, sf_dir):
    """The state out of a snapshot and later batches."""
    return _stored_log(spark, sf_dir, sample.incident_log(spark, sf_dir)).state().select(
        "tracking_id", "latest_run_id", "classification", "retry_count", "status", _plain_time("last_updated_at"),
        _joined("all_run_ids"), "version")


@query
def store_known_ids(spark, sf_dir):
    """The ids that runs of the lookback can have, out of the segments that reach it."""
    store = _stored_log(spark, sf_dir, sample.incident_log(spark, sf_dir))
    return store.known_run_ids(since=AS_OF - SETTINGS.lookback)


@query
def run_retries(spark, sf_dir):
    """A pass over the own state only: retries that are due by their recorded time, others
    that are not, and outcomes."""
    settings = Settings(retry_delay=timedelta(hours=sample.HISTORY_DELAY_HOURS))
    store = TriageStore(spark, scratch_path(spark, "executor"), settings)
    store.append_events(sample.slow_log(spark, sf_dir), Batch("history", 1))
    runs = sample.dated_runs(spark, sf_dir).where(F.col("start_time") <= sample.ntz(sample.SEEN))
    inputs = Inputs(runs, sample.run_outputs(spark, sf_dir), sample.jobs(spark, sf_dir))
    run_only_retries(store, inputs, sample.SEEN, 1, Judgement(settings))
    requested = store.retry_requests().select("tracking_id", F.lit(True).alias("requested"))
    return store.state().join(requested, "tracking_id", "left").select(
        "tracking_id", "classification", "retry_count", "status", _plain_time("next_retry_at"),
        F.coalesce("requested", F.lit(False)).alias("requested"))


def _retry_runs(store, runs):
    """What became of requested retries: every third one succeeded, every third one failed,
    and the others do not show in the run table yet."""
    first = store.state().select("tracking_id", "original_run_id")
    number = F.col("original_run_id").cast("long")
    started = sample.ntz(AS_OF + timedelta(minutes=17))
    return store.retry_requests().select("tracking_id", "job_id").join(first, "tracking_id").select(
        "tracking_id", "job_id", F.concat(F.lit("a"), "original_run_id").alias("run_id"), number.alias("number"),
        started.alias("start_time"), F.lit(fixed.TERMINATED).alias("life_cycle_state"),
        F.when(number % 3 == 0, fixed.SUCCESS).when(number % 3 == 1, fixed.FAILED).alias("result_state"),
        F.array(F.struct(F.concat(F.lit("ta"), "original_run_id").alias("run_id"))).alias("tasks"))


@query
def run_cycle_acked(spark, sf_dir):
    """Three passes: failures, requests, then acks of all requests, of which a third has no
    run in the table. No job of these gets another run."""
    store = TriageStore(spark, scratch_path(spark, "cycle"))
    runs, outputs = sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir)
    inputs = Inputs(runs, outputs, sample.jobs(spark, sf_dir))
    run_one_cycle(store, inputs, AS_OF, 1)
    run_one_cycle(store, inputs, AS_OF + timedelta(minutes=16), 2)
    retried = written(_retry_runs(store, runs), "retried")
    shown = retried.where(F.col("result_state").isNotNull())
    error = F.when(F.col("number") % 2 == 0, sample.ERRORS[3][0]).otherwise(sample.ERRORS[0][0])
    inputs = Inputs(
        runs.select(*schemas.RUNS.names).unionByName(shown.select(*schemas.RUNS.names)),
        outputs.unionByName(shown.select(
            F.get("tasks", F.lit(0))["run_id"].alias("task_run_id"), error.alias("error"), F.lit(None).cast("string").alias("error_trace"))),
        inputs.jobs, retry_acks=retried.select("tracking_id", F.col("run_id").alias("new_run_id"), F.col("start_time").alias("started_at")))
    run_one_cycle(store, inputs, AS_OF + timedelta(minutes=32), 3)
    requested = store.retry_requests().select("tracking_id").distinct().withColumn("requested", F.lit(True))
    return store.state().join(requested, "tracking_id", "left").select(
        "job_id", "original_run_id", "latest_run_id", "classification", "retry_count", "status",
        F.coalesce("requested", F.lit(False)).alias("requested"))


@query
def store_corrections(spark, sf_dir):
    """A person's labels taken into the log: what waited for review goes on."""
    store = TriageStore(spark, scratch_path(spark, "corrections"))
    closed = sample.incident_log(spark, sf_dir).join(
        sample.incidents(spark, sf_dir).where(F.col("classification") != fixed.TRANSIENT).select("tracking_id"), "tracking_id", "left_semi")
    store.append_events(closed, Batch("history", 1))
    inputs = Inputs(
        sample.runs(spark, sf_dir), sample.run_outputs(spark, sf_dir), sample.jobs(spark, sf_dir),
        corrections=sample.corrections(spark, sf_dir))
    run_only_retries(store, inputs, AS_OF, 1)
    illegal = reports.illegal_transitions(store.events()).select("tracking_id", F.lit(True).alias("illegal"))
    return store.state().join(illegal, "tracking_id", "left").select(
        "tracking_id", "classification", "status", _plain_time("next_retry_at"), "version",
        F.coalesce("illegal", F.lit(False)).alias("illegal"))


# --- reports over the log ----------------------------------------------------------------------


@query
def state_as_of(spark, sf_dir):
    rows = state.state_as_of(sample.incident_log(spark, sf_dir), sample.SEEN)
    return rows.select("tracking_id", "classification", "retry_count", "status", "last_updated_at", "version")


@query
def audit_report_log(spark, sf_dir):
    return reports.audit_log(sample.corrected_log(spark, sf_dir), sample.SEEN)


@query
def label_lineage(spark, sf_dir):
    return reports.label_lineage(sample.corrected_log(spark, sf_dir)).select(
        "tracking_id", "seq", "event", "label", "label_before")


@query
def stream_timeline(spark, sf_dir):
    """Ended runs out of a stream of periods."""
    events = _event_stream(spark, sf_dir)
    runs = sample.runs_from_events(events)
    periods = F.expr("array(named_struct('a', 1, 'b', 2, 'r', result_state), named_struct('a', 0, 'b', 1, 'r', NULL))")
    rows = runs.select("job_id", "run_id", "start_time", "tasks", F.explode(periods).alias("p")).selectExpr(
        "job_id", "run_id", "CAST(start_time + make_dt_interval(0, 0, p.a) AS timestamp) AS period_start_time",
        "CAST(start_time + make_dt_interval(0, 0, p.b) AS timestamp) AS period_end_time", "p.r AS result_state", "tasks")
    path = scratch_path(spark, "timeline")
    ended = runs_from_timeline_stream(rows, SETTINGS, wait=False)
    _finish(ended.writeStream.format("parquet").option("path", f"{path}/runs").option("checkpointLocation", f"{path}/checkpoint"))
    found = run_ops.scan_runs(spark.read.schema(schemas.RUNS).parquet(f"{path}/runs"))
    return found.select("job_id", "run_id", _plain_time("start_time"), "result_state", "task_run_id")
