"""What became of retries that were started."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend import fixed
from runmend.functions.clock import instant_like, utc_clock
from runmend.operators import joins
from runmend.operators.classify import Classifier, classify_by_rules, decide
from runmend.operators.detect import with_error_text
from runmend.operators.incidents import rows_by_status
from runmend.operators.runs import days_of, of_days, one_row_per_run, scan_runs, started_since
from runmend.settings import Settings

STILL_RUNNING = "still_running"


def outcome_states(
    incidents: DataFrame, runs: DataFrame, run_outputs: DataFrame, settings: Settings = Settings(),
) -> DataFrame:
    """Status each retried incident's run leads to; null, with the run's error_message,
    where that depends on the label of the new error.

    Any finished state but success is a failed retry. A run that is not in the
    snapshot, or has no result yet, is still running. Error texts are looked up only
    for rows that need a new decision.

    A run table with ``run_date`` is read on the days that the retries' runs can have
    started: the recorded one with a day on either side, or, where the ack told none, those
    from the failure to the ack. So an old row does not widen the scan for the others.
    """
    columns = ["tracking_id", "job_id", "run_id", "retry_count"]
    columns += [c for c in ("version",) if c in incidents.columns]
    retried = rows_by_status(incidents, fixed.RETRIED).withColumn("run_id", F.col("latest_run_id"))
    small, first_failure = joins.measure(retried, "first_failed_at", settings, "run_id")
    days: list | None = None
    if first_failure is None:
        runs, since = runs.limit(0), None
    elif "run_date" in runs.columns:
        since, slack = None, max(1, settings.clock_margin.days)
        days = start_days(retried)
        runs = of_days(runs, days, slack)
        if "run_date" in run_outputs.columns:
            # An output is written on the day of its run.
            run_outputs = of_days(run_outputs, days, slack)
    else:
        # A retry starts after the failure it answers; a day is left for unequal clocks.
        since = instant_like(first_failure, incidents, "first_failed_at", settings.clock_margin)
        runs = started_since(runs, since)
    retried = retried.select(columns)

    # A run of several rows has the state of its newest one; only wanted runs are merged.
    states = joins.keep_keys(scan_runs(runs), retried, "run_id", small)
    states = one_row_per_run(states).select("run_id", "result_state", "task_run_id")
    rows = joins.lookup(retried, states, "run_id", small, row_id="tracking_id")
    rows = rows.withColumn(
        "status",
        F.when(F.col("result_state").isNull(), STILL_RUNNING)
        .when(F.col("result_state") == fixed.SUCCESS, fixed.RESOLVED)
        .when(F.col("retry_count") >= settings.max_retries, fixed.MAX_RETRIES_REACHED))
    open_question = F.col("status").isNull()
    rows = rows.withColumn("task_run_id", F.when(open_question, F.col("task_run_id")))
    return with_error_text(rows, run_outputs, settings, small, since).select(
        *columns, F.when(open_question, F.col("error_message")).alias("error_message"), "status")


def start_days(retried: DataFrame) -> list[date]:
    """The days that the runs of retried rows can have started on."""
    def day(column: str) -> Column:
        return F.to_date(utc_clock(column, retried.schema[column].dataType))

    failed = day("first_failed_at")
    if "run_started_at" in retried.columns:
        known = F.when(F.col("run_started_at").isNotNull(), F.array(day("run_started_at")))
    else:
        known = F.lit(None).cast("array<date>")
    possible = F.sequence(failed, F.greatest(failed, day("last_updated_at")))
    return days_of(retried.select(F.explode(F.coalesce(known, possible)).alias("day")), F.col("day"))


def check_outcomes(
    incidents: DataFrame, runs: DataFrame, run_outputs: DataFrame,
    settings: Settings = Settings(), classify: Classifier = classify_by_rules,
) -> DataFrame:
    """Outcome of each retried incident: still_running, resolved, max_retries_reached,
    or the status its new error leads to, with the new error and label."""
    return decide(classify(outcome_states(incidents, runs, run_outputs, settings)))
