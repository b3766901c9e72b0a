"""Retries of transient failures: which are due, which are safe, what to request."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend import fixed, schemas
from runmend.functions.clock import instant_like
from runmend.operators import joins, runs as run_ops
from runmend.operators.incidents import RETRY_REQUESTED, backfill_run_ids, rows_by_status
from runmend.operators.outcomes import STILL_RUNNING
from runmend.operators.runs import id_order
from runmend.settings import Settings

NOT_DUE = "not_due"
SKIP_IN_PROGRESS = "skip_in_progress"
SKIP_SAME_PASS = "skip_same_pass"
RETRY = "retry"


def is_due(incidents: DataFrame, as_of: datetime, settings: Settings) -> Column:
    """The delay since the last update has passed, exactly or by more."""
    return F.col("last_updated_at") <= instant_like(
        as_of, incidents, "last_updated_at", settings.retry_delay)


def is_due_at(incidents: DataFrame, as_of: datetime, settings: Settings) -> Column:
    """The recorded retry time has come; for rows without one, the delay has passed."""
    return F.coalesce(
        F.col("next_retry_at") <= instant_like(as_of, incidents, "next_retry_at"),
        is_due(incidents, as_of, settings))


def due_rows(incidents: DataFrame, as_of: datetime, settings: Settings = Settings()) -> DataFrame:
    scheduled = rows_by_status(incidents, fixed.RETRY_SCHEDULED)
    return scheduled.where(is_due(incidents, as_of, settings))


def due_rows_by_time(incidents: DataFrame, as_of: datetime, settings: Settings = Settings()) -> DataFrame:
    scheduled = rows_by_status(incidents, fixed.RETRY_SCHEDULED)
    return scheduled.where(is_due_at(incidents, as_of, settings))


def with_job_activity(
    rows: DataFrame, runs: DataFrame, settings: Settings, ranked: bool = False,
) -> tuple[DataFrame, bool]:
    """Rows, which have a first_failed_at, with the activity of their job, and whether
    their jobs are few. ``ranked`` runs are the newest of each job already, as a store keeps
    them; otherwise the run table is read, its history for jobs with an old active run."""
    small, first_failure = joins.measure(rows, "first_failed_at", settings, "job_id")
    if ranked:
        runs = joins.keep_keys(runs, rows, "job_id", small) if small else runs
    elif first_failure is None:
        runs = runs.limit(0)
    else:
        since = instant_like(first_failure, rows, "first_failed_at")
        runs = run_ops.runs_that_matter(runs, since, rows, settings, small)
    activity = run_ops.job_activity(runs, settings)
    return joins.join_dimension(rows, activity, "job_id", "tracking_id", small, settings), small


def newer_success(
    incidents: DataFrame, runs: DataFrame, settings: Settings = Settings(), ranked: bool = False,
) -> DataFrame:
    """Incidents whose job has a success that started after they first failed."""
    rows, _ = with_job_activity(incidents, runs, settings, ranked)
    return rows.where(run_ops.is_newer_success(F.col("last_success_at"), F.col("first_failed_at")))


def plan_retries(
    incidents: DataFrame, runs: DataFrame, as_of: datetime, settings: Settings = Settings(),
    by_time: bool = False, in_flight: DataFrame | None = None, ranked: bool = False,
) -> DataFrame:
    """What to do with each scheduled retry: not_due, resolved, skip_in_progress, retry
    or skip_same_pass.

    ``in_flight`` names jobs (job_id) whose retry was started and has no result yet, whether
    the run table shows its run or not: they are in progress. Of the rows of a job that may
    be retried, only one is, as its new run blocks the others: the one that a run was
    requested for already, else the one that failed first. That row is a minimum per job, combined before the
    shuffle, so a job with very many incidents is not ranked in one task.
    """
    due = is_due_at(incidents, as_of, settings) if by_time else is_due(incidents, as_of, settings)
    scheduled = rows_by_status(incidents, fixed.RETRY_SCHEDULED).select(
        "tracking_id", "job_id", "first_failed_at", due.alias("due"),
        *[c for c in ("version", "retry_count", "requested_at") if c in incidents.columns])
    rows, small = with_job_activity(scheduled, runs, settings, ranked)
    busy = F.coalesce("in_progress", F.lit(False))
    if in_flight is not None:
        leases = in_flight.select("job_id").distinct().withColumn("_leased", F.lit(True))
        rows = joins.join_dimension(rows, leases, "job_id", "tracking_id", joins.is_small(leases, settings), settings)
        busy = busy | F.coalesce("_leased", F.lit(False))
    waiting = F.col("requested_at").isNull() if "requested_at" in incidents.columns else F.lit(True)
    judged = rows.withColumn(
        "_blocked",
        F.when(~F.col("due"), NOT_DUE)
        .when(run_ops.is_newer_success(F.col("last_success_at"), F.col("first_failed_at")), fixed.RESOLVED)
        .when(busy, SKIP_IN_PROGRESS))
    firsts = (
        judged.where(F.col("_blocked").isNull())
        .groupBy("job_id").agg(F.min(F.struct(waiting.alias("_waiting"), "first_failed_at", "tracking_id")).alias("_first"))
        .select("job_id", F.col("_first.tracking_id").alias("_chosen"))
    )
    action = (
        F.when(F.col("_blocked").isNotNull(), F.col("_blocked"))
        .when(F.col("tracking_id") == F.col("_chosen"), RETRY)
        .otherwise(SKIP_SAME_PASS))
    return (
        joins.join_dimension(judged, firsts, "job_id", "tracking_id", small, settings)
        .select(*scheduled.columns, action.alias("action"))
        .drop("due")
    )


def in_flight(outcomes: DataFrame) -> DataFrame:
    """Jobs that have a retry without a result. ``outcomes`` are those of the open rows."""
    return outcomes.where(F.col("status") == STILL_RUNNING).select("job_id").distinct()


def request_notes(plan: DataFrame) -> DataFrame:
    """Moves that note the first request of a retry, so that it holds its job until its
    run is there. A request that is repeated is noted already."""
    return plan.where((F.col("action") == RETRY) & F.col("requested_at").isNull()).select(
        "tracking_id", "job_id", "version", F.lit(fixed.RETRY_SCHEDULED).alias("status"), F.lit(RETRY_REQUESTED).alias("event"))


def retry_requests(plan: DataFrame, as_of: Column) -> DataFrame:
    """One request per planned retry. The id names the attempt, so a request repeated
    before its run shows up is recognised as the same one."""
    attempt = F.col("retry_count") + 1
    return plan.where(F.col("action") == RETRY).select(
        F.sha2(F.concat_ws(":", "tracking_id", attempt.cast("string")), 256).alias("request_id"),
        "tracking_id", "job_id", as_of.alias("requested_at"))


def apply_retry_acks(incidents: DataFrame, acks: DataFrame) -> DataFrame:
    """Incidents whose requested run was started, as retried rows: count raised, run id
    appended, start of the run kept. An ack whose run is in the history already is skipped; of
    several new acks for an incident the smallest run id is taken, the others stay for later."""
    scheduled = backfill_run_ids(rows_by_status(incidents, fixed.RETRY_SCHEDULED)).drop("run_started_at")
    acks = schemas.evolve(acks, schemas.DATED_ACKS)
    fresh = scheduled.join(acks, "tracking_id").where(
        ~F.array_contains("all_run_ids", F.col("new_run_id")))
    first = F.min_by(F.struct("new_run_id", F.col("started_at").alias("run_started_at")), id_order(F.col("new_run_id")))
    chosen = fresh.groupBy("tracking_id").agg(first.alias("_first")).select("tracking_id", "_first.*")
    return (
        scheduled.join(chosen, "tracking_id")
        .withColumn("latest_run_id", F.col("new_run_id"))
        .withColumn("all_run_ids", F.array_union("all_run_ids", F.array("new_run_id")))
        .withColumn("retry_count", F.col("retry_count") + 1)
        .withColumn("status", F.lit(fixed.RETRIED))
        .drop("new_run_id")
    )

