"""Scans and per-job summaries of runs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runmend import fixed
from runmend.functions.clock import instant_like, whole_millis
from runmend.operators.joins import is_small, keep_keys
from runmend.settings import Settings

# Columns a plan carries when it does not look at error texts.
STATE_COLUMNS = ["job_id", "run_id", "start_time", "life_cycle_state", "result_state"]


def scan_runs(runs: DataFrame) -> DataFrame:
    """All runs, ids as strings, with the id of the first task."""
    return runs.select(
        F.col("job_id").cast("string").alias("job_id"),
        F.col("run_id").cast("string").alias("run_id"),
        "start_time", "life_cycle_state", "result_state",
        F.get("tasks", F.lit(0))["run_id"].cast("string").alias("task_run_id"),
    )


def monitored_runs(runs: DataFrame, monitored: DataFrame, small: bool) -> DataFrame:
    keys = monitored.select("job_id")
    return runs.join(F.broadcast(keys) if small else keys, "job_id", "left_semi")


def tagged_jobs(job_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Ids of the jobs that carry one of the tags."""
    return job_tags.where(F.col("tag").isin(tags)).select("job_id").distinct()


def started_since(runs: DataFrame, start: Column) -> DataFrame:
    """Runs that started at or after ``start``. A table partitioned by ``run_date``, the
    UTC day of the start, is read from about that day on."""
    since = runs.where(F.col("start_time") >= start)
    return dated_since(since, start)


def dated_since(rows: DataFrame, start: Column) -> DataFrame:
    """Rows from the day of ``start`` on, where the table has a ``run_date``. The day is
    taken in the session's zone, which is a day ahead of UTC at most."""
    if "run_date" not in rows.columns:
        return rows
    return rows.where(F.col("run_date") >= F.date_sub(F.to_date(start), 1))


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("result_state") == fixed.FAILED)


def within_lookback(runs: DataFrame, as_of: datetime, settings: Settings) -> DataFrame:
    """Runs that started at or after ``as_of`` minus the lookback."""
    return started_since(runs, instant_like(as_of, runs, "start_time", settings.lookback))


def id_number(run_id: Column) -> Column:
    """The id as a number, null for one that is none: ``999`` comes before ``1000``."""
    return F.when(run_id.rlike("^[0-9]{1,38}$"), run_id.cast("decimal(38,0)"))


def id_order(run_id: Column) -> Column:
    """Orders ids: others by text, then numbers by value, equal ones by text."""
    return F.struct(id_number(run_id).alias("number"), run_id.alias("text"))


def _newest_first() -> list[Column]:
    run_id = F.col("run_id")
    return [F.desc("start_time"), F.desc_nulls_last(id_number(run_id)), run_id.desc()]


def _state_order(columns: list[str]) -> Column:
    """Of several rows of a run: one with a result, then the one written last; the rest
    only settles ties."""
    known = [F.col("result_state").isNotNull()] if "result_state" in columns else []
    return F.struct(*known, *[F.col(c) for c in ("updated_at", "start_time", "life_cycle_state", "result_state") if c in columns])


def one_row_per_run(runs: DataFrame) -> DataFrame:
    """The newest state of each run. A table that is partitioned by job already is not
    shuffled again."""
    others = [c for c in runs.columns if c not in ("job_id", "run_id")]
    newest = F.max_by(F.struct(*others), _state_order(others))
    return runs.groupBy("job_id", "run_id").agg(newest.alias("_newest")).select(
        *[F.col(f"_newest.{c}").alias(c) if c in others else F.col(c) for c in runs.columns])


def newest_per_job(runs: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` runs of each job, one row each. Every task keeps the rows of at
    most ``limit`` runs of a job before the shuffle, so a hot job arrives as a few rows per
    task. Rows of one run have its start time, so they share a rank and are merged after
    the cut."""
    if limit is None:
        return one_row_per_run(runs)
    newest_first = Window.partitionBy("job_id").orderBy(*_newest_first())
    newest = (
        runs.withColumn("_rank", F.dense_rank().over(newest_first))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )
    return one_row_per_run(newest)


def runs_from_timeline(timeline: DataFrame) -> DataFrame:
    """Runs of a table with a row for each period of a run (job_id, run_id,
    period_start_time, period_end_time, result_state, tasks): repeated rows and their order
    in the table change nothing. A run starts with its first period, and is over once a
    period has a result; of several results the one of the latest period counts."""
    latest = F.struct(F.coalesce("period_end_time", "period_start_time"), "period_start_time")
    result = F.max_by("result_state", F.when(F.col("result_state").isNotNull(), latest))
    return timeline.groupBy("job_id", "run_id").agg(
        F.min("period_start_time").alias("start_time"),
        result.alias("result_state"),
        F.max_by("tasks", F.when(F.col("tasks").isNotNull(), latest)).alias("tasks"),
        F.max(F.coalesce("period_end_time", "period_start_time")).alias("updated_at"),
    ).select(
        "job_id", "run_id", "start_time",
        F.when(F.col("result_state").isNull(), fixed.ACTIVE_STATES[0]).otherwise(fixed.TERMINATED).alias("life_cycle_state"),
        "result_state", "tasks", "updated_at")


def as_recent(runs: DataFrame, seen_at: datetime, settings: Settings) -> DataFrame:
    """The newest runs of each job among ``runs``, as seen at that time."""
    newest = newest_per_job(runs.select(STATE_COLUMNS), settings.safety_runs_per_job)
    return newest.withColumn("seen_at", instant_like(seen_at, runs, "start_time"))


def newest_versions(versions: DataFrame, settings: Settings) -> DataFrame:
    """The newest runs of each job out of several looks at the run table, each of which has
    the newest runs per job among the rows it read. A run has the state it was seen in last.
    No look has more rows of a job than the cap, so a hot job arrives as a few rows."""
    others = [c for c in versions.columns if c not in ("job_id", "run_id")]
    last = F.max_by(F.struct(*others), "seen_at")
    runs = versions.groupBy("job_id", "run_id").agg(last.alias("_last")).select("job_id", "run_id", "_last.*")
    return newest_per_job(runs.select(versions.columns), settings.safety_runs_per_job)


def days_of(rows: DataFrame, day: Column) -> list[date]:
    """The different days of ``rows``; there are few, whatever the number of rows."""
    return sorted(r[0] for r in rows.select(day.cast("date").alias("day")).distinct().collect() if r[0] is not None)


def of_days(rows: DataFrame, days: list[date], slack: int = 0) -> DataFrame:
    """Rows of the days given and ``slack`` days around them, where the table has a
    ``run_date``: other partitions are not listed."""
    if "run_date" not in rows.columns:
        return rows
    around = sorted({d + timedelta(days=n) for d in days for n in range(-slack, slack + 1)})
    return rows.where(F.col("run_date").isin([F.lit(d) for d in around]))


def changed_runs(runs: DataFrame, recent: DataFrame, since: datetime) -> DataFrame:
    """Rows of the run table that the newest runs per job may lack: those that started since
    then, and those of the days on which a run started that was active when ``recent`` was
    made. Both reads name their days."""
    from_then = instant_like(since, runs, "start_time")
    active = recent.where(F.col("life_cycle_state").isin(fixed.ACTIVE_STATES))
    late = active.where(F.col("start_time") < from_then.cast(recent.schema["start_time"].dataType))
    days = days_of(late, F.col("start_time"))
    fresh = started_since(runs, from_then)
    if not days:
        return fresh
    older = of_days(runs.where(F.col("start_time") < from_then), days, 1)
    return fresh.unionByName(older)


def _success_start() -> Column:
    return F.max(F.when(F.col("result_state") == fixed.SUCCESS, F.col("start_time")))


def _is_active() -> Column:
    return F.bool_or(F.col("life_cycle_state").isin(fixed.ACTIVE_STATES))


def last_success_per_job(runs: DataFrame, settings: Settings) -> DataFrame:
    """Start of the newest success among each job's newest runs."""
    return (
        newest_per_job(runs.select(STATE_COLUMNS), settings.safety_runs_per_job)
        .groupBy("job_id").agg(_success_start().alias("last_success_at"))
        .where(F.col("last_success_at").isNotNull())
    )


def jobs_in_progress(runs: DataFrame, settings: Settings) -> DataFrame:
    """Jobs with a running or pending run among their newest runs."""
    return (
        newest_per_job(runs.select(STATE_COLUMNS), settings.safety_runs_per_job)
        .groupBy("job_id").agg(_is_active().alias("in_progress"))
        .where("in_progress")
        .select("job_id")
    )


def job_activity(runs: DataFrame, settings: Settings) -> DataFrame:
    """One row per job: newest success and whether a run is active. The two aggregates
    use the partitioning of the rank, so this is a single shuffle."""
    return (
        newest_per_job(runs.select(STATE_COLUMNS), settings.safety_runs_per_job)
        .groupBy("job_id")
        .agg(_success_start().alias("last_success_at"), _is_active().alias("in_progress"))
    )


def runs_that_matter(
    runs: DataFrame, first_failure: Column, rows: DataFrame, settings: Settings, small: bool,
) -> DataFrame:
    """The runs that decide the activity of the jobs of ``rows``, which all failed at or
    after ``first_failure``.

    Runs since then keep their rank among the newest. An older run cannot be a newer
    success; it matters only when it is still active, and then all runs of its job are
    needed to rank it. Old active runs are rare, so the history is read for the few
    jobs that have one, and not at all when there is none.
    """
    runs = runs.select(STATE_COLUMNS + [c for c in ("run_date",) if c in runs.columns])
    if small:
        # Few rows name few jobs: the runs of other jobs go no further than the scan.
        runs = keep_keys(runs, rows, "job_id", small=True)
    recent = started_since(runs, first_failure)
    older = runs.where(F.col("start_time") < first_failure)
    lasting = older.where(F.col("life_cycle_state").isin(fixed.ACTIVE_STATES)).select("job_id").distinct()
    few = small or is_small(lasting, settings)
    return recent.unionByName(keep_keys(older, lasting, "job_id", few))


def is_newer_success(last_success_at: Column, first_failed_at: Column) -> Column:
    """Strictly newer, in whole milliseconds; false when the job has no success."""
    return F.coalesce(
        whole_millis(last_success_at) > whole_millis(first_failed_at), F.lit(False))


def latest_run_status(runs: DataFrame) -> DataFrame:
    """State of each job's newest run."""
    newest = F.max_by(
        F.struct("run_id", "start_time", "life_cycle_state", "result_state"),
        F.struct("start_time", id_order(F.col("run_id")), _state_order(STATE_COLUMNS)))
    return runs.groupBy("job_id").agg(newest.alias("newest")).select("job_id", "newest.*")
