"""Finding failed runs that are not tracked yet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend.functions.clock import instant_like
from runmend.operators import joins
from runmend.operators.runs import (
    dated_since, failed_runs, newest_per_job, scan_runs, within_lookback)
from runmend.session import shared_dir
from runmend.settings import Settings


def tracked_runs(incidents: DataFrame) -> DataFrame:
    """The run ids of every incident's history. A row without a history gives none."""
    return incidents.select(F.explode("all_run_ids").alias("run_id"))


def known_run_ids(incidents: DataFrame) -> DataFrame:
    """Every tracked run id, once."""
    return tracked_runs(incidents).distinct()


def untracked(rows: DataFrame, known: DataFrame, small: bool = False) -> DataFrame:
    """Rows whose run id is not among ``known.run_id``, which may repeat.

    When the rows are few, the long history of known ids is only filtered by them, and
    what is left of it, at most one id per row, is broadcast back.
    """
    known = known.select("run_id")
    if small:
        known = F.broadcast(joins.keep_keys(known, rows, "run_id", small=True).distinct())
    return rows.join(known, "run_id", "left_anti")


def error_text(error: Column, settings: Settings) -> Column:
    """The error, or the default text when it is missing or empty."""
    return F.coalesce(F.when(error != "", error), F.lit(settings.no_error_text))


def with_error_text(
    runs: DataFrame, run_outputs: DataFrame, settings: Settings, small: bool,
    since: Column | None = None,
) -> DataFrame:
    """``runs`` with ``error_message``, read from the output of the first task. When all
    of them started at ``since`` or later, older days of outputs are not read."""
    outputs = run_outputs if since is None else dated_since(run_outputs, since)
    outputs = outputs.select("task_run_id", "error")
    found = joins.lookup(runs, outputs, "task_run_id", small, row_id="run_id")
    return found.withColumn("error_message", error_text(F.col("error"), settings)).drop("error")


def recent_failures(
    runs: DataFrame, as_of: datetime, settings: Settings, monitored: DataFrame | None = None,
) -> DataFrame:
    """Failed runs among the newest of their job, tracked or not.

    The cap per job counts runs of every state, so the state test comes after it. The
    lookback comes before it, although the definition has it after: runs are ranked
    newest first, so a run inside the lookback has only runs inside the lookback ahead
    of it and keeps its rank. That lets the time test reach the scan.
    """
    small = monitored is not None and joins.is_small(monitored, settings, "job_id")
    recent = scan_runs(within_lookback(runs, as_of, settings))
    if monitored is not None and small:
        recent = joins.keep_keys(recent, monitored, "job_id", small=True)
    newest = newest_per_job(
        recent.select("job_id", "run_id", "start_time", "result_state", "task_run_id"),
        settings.runs_per_job)
    if monitored is not None and not small:
        # Same result after the cap, where a hot job is down to the capped rows.
        newest = joins.keep_keys(newest, monitored, "job_id", small=False)
    return failed_runs(newest).drop("result_state")


def detect_new_failures(
    runs: DataFrame, run_outputs: DataFrame, known: DataFrame, as_of: datetime,
    settings: Settings = Settings(), monitored: DataFrame | None = None,
) -> DataFrame:
    """job_id, run_id, error_message and start_time of each failure to be tracked.
    ``known`` holds the run ids that are tracked already."""
    shared_dir(runs.sparkSession)
    failed = recent_failures(runs, as_of, settings, monitored)
    # Ranked once: the few rows left are counted, looked up and given out from this table.
    failed = failed.checkpoint()
    small = joins.is_small(failed, settings, "run_id", "task_run_id")
    since = instant_like(as_of, runs, "start_time", settings.lookback)
    found = untracked(failed, known, small)
    return with_error_text(found, run_outputs, settings, small, since).select(
        "job_id", "run_id", "error_message", "start_time")


def valid_events(events: DataFrame) -> DataFrame:
    """Events with all three fields filled; the others call for a full scan."""
    return events.where(is_valid_event())


def is_valid_event() -> Column:
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("job_id", "run_id", "error_message")]
    return filled[0] & filled[1] & filled[2]


def event_failures(events: DataFrame, as_of: Column) -> DataFrame:
    """Valid events in the shape of detected failures, dated ``as_of`` when undated."""
    return valid_events(events).select(
        "job_id", "run_id", "error_message",
        F.coalesce("triggered_at", as_of).alias("start_time"))


def merge_failures(from_events: DataFrame, from_scan: DataFrame) -> DataFrame:
    """Both inputs of the tracker, each run once; an event wins over the scan."""
    columns = ["job_id", "run_id", "error_message", "start_time"]
    both = (
        from_events.select(*columns, F.lit(0).alias("_rank"))
        .unionByName(from_scan.select(*columns, F.lit(1).alias("_rank")))
    )
    first = F.min_by(
        F.struct("job_id", "error_message", "start_time"),
        F.struct("_rank", "start_time", "job_id", "error_message"))
    return both.groupBy("run_id").agg(first.alias("_first")).select(
        "_first.job_id", "run_id", "_first.error_message", "_first.start_time")
