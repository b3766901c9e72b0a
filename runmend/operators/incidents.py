"""Incident state: an append-only event log, folded into one row per incident."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend import fixed, schemas
from runmend.functions.clock import instant, instant_like
from runmend.settings import Settings

FIX_STORED = "fix_stored"
RETRY_REQUESTED = "retry_requested"
LABEL_CORRECTED = "label_corrected"
CORRECTED = "corrected"
# Events that note something and leave the status, and the time of the last update, alone.
NOTES = [FIX_STORED, RETRY_REQUESTED, LABEL_CORRECTED]
# Events whose run belongs to the incident's history.
RUN_EVENTS = [fixed.DETECTED, fixed.RETRIED]


def tracking_id(job_id: Column, run_id: Column) -> Column:
    """The same run always gives the same id, so a replay inserts nothing twice."""
    return F.sha2(F.concat(job_id, F.lit(":"), run_id), 256)


def failed_at(failures: DataFrame, as_of: datetime, settings: Settings) -> Column:
    now = instant_like(as_of, failures, "start_time")
    if settings.first_failed_basis == "detection":
        return now
    return F.coalesce("start_time", now)


def insert_incidents(failures: DataFrame, as_of: datetime, settings: Settings = Settings()) -> DataFrame:
    """State rows of new failures, status detected."""
    now = instant_like(as_of, failures, "start_time")
    return failures.select(
        tracking_id(F.col("job_id"), F.col("run_id")).alias("tracking_id"),
        "job_id",
        F.col("run_id").alias("original_run_id"),
        F.col("run_id").alias("latest_run_id"),
        "error_message",
        F.lit(None).cast("string").alias("classification"),
        F.lit(0).alias("retry_count"),
        F.lit(fixed.DETECTED).alias("status"),
        failed_at(failures, as_of, settings).alias("first_failed_at"),
        now.alias("last_updated_at"),
        F.array("run_id").alias("all_run_ids"),
        F.lit(1).alias("version"),
    )


def begin_tracking(failures: DataFrame, as_of: datetime, settings: Settings = Settings()) -> DataFrame:
    """Failures as incidents without events: version 0."""
    return failures.select(
        tracking_id(F.col("job_id"), F.col("run_id")).alias("tracking_id"),
        "job_id", "run_id", "error_message",
        failed_at(failures, as_of, settings).cast("timestamp").alias("failed_at"),
        F.lit(0).alias("version"))


def next_retry(status: Column, now: Column, settings: Settings) -> Column:
    """When a scheduled retry is due; null for other statuses."""
    due = now.cast("timestamp") + F.make_dt_interval(mins=F.lit(0), secs=F.lit(
        settings.retry_delay.total_seconds()))
    return F.when(status == fixed.RETRY_SCHEDULED, due)


def events_of(moves: DataFrame, as_of: datetime, settings: Settings = Settings()) -> DataFrame:
    """Events that move incidents to ``moves.status``, numbered on from their version.

    ``moves`` has tracking_id, job_id, version and status and, where they apply, run_id,
    error_message, label columns and fix_suggestion, and ``event`` where the label columns
    do not tell it. An incident without events is
    detected first; both of its events come from the one row.
    """
    moves = schemas.evolve(moves, schemas.EVENT_LOG).withColumnRenamed("event", "_event")
    now = instant(as_of, T.TimestampType())
    is_new = F.col("version") == 0
    told = ["classification", "reasoning", "confidence", "parse_status", "raw_response", "fix_suggestion"]
    detected = F.struct(
        F.lit(1).alias("seq"), F.lit(fixed.DETECTED).alias("event"),
        F.lit(fixed.DETECTED).alias("status"), "failed_at",
        *[F.lit(None).cast("string").alias(c) for c in told],
        F.lit(None).cast("timestamp").alias("next_retry_at"),
        F.lit(None).cast("timestamp").alias("run_started_at"), F.lit(None).cast("timestamp").alias("corrected_at"))
    moved = F.struct(
        F.when(is_new, 2).otherwise(F.col("version") + 1).alias("seq"),
        F.coalesce("_event", F.when(F.col("classification").isNotNull(), fixed.CLASSIFIED)
                   .otherwise(F.col("status"))).alias("event"),
        "status", F.lit(None).cast("timestamp").alias("failed_at"), *told,
        F.when(~F.coalesce(F.col("_event").isin(NOTES), F.lit(False)), next_retry(F.col("status"), now, settings)).alias("next_retry_at"),
        F.col("run_started_at").cast("timestamp").alias("run_started_at"), F.col("corrected_at").cast("timestamp").alias("corrected_at"))
    both = F.when(is_new, F.array(detected, moved)).otherwise(F.array(moved))
    events = moves.select(
        "tracking_id", now.alias("ts"), "job_id", "run_id", "error_message", F.explode(both).alias("e"))
    return schemas.conform(events.select("*", "e.*"), schemas.EVENT_LOG)


def store_fix_events(fixes: DataFrame, as_of: datetime) -> DataFrame:
    """Events that put a fix suggestion on an incident and leave its status alone.
    ``fixes`` has tracking_id, job_id, version, status and fix_suggestion."""
    return schemas.conform(
        fixes.select(
            "tracking_id", "job_id", (F.col("version") + 1).alias("seq"),
            F.lit(FIX_STORED).alias("event"), instant(as_of, T.TimestampType()).alias("ts"),
            "status", "fix_suggestion"),
        schemas.INCIDENT_EVENTS)


def reduce_events(events: DataFrame) -> DataFrame:
    """One row per incident with what its events say; null where they say nothing.

    Everything is a partially aggregated reduction. A repeated event does not count
    twice: the run ids are collected as a set of (seq, run id, is a retry), which holds
    one entry per attempt.
    """
    events = schemas.evolve(events, T.StructType([
        schemas.EVENT_LOG["run_started_at"], schemas.EVENT_LOG["corrected_at"]]))
    order = F.struct("seq", "ts")

    def newest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    detected = F.col("event") == fixed.DETECTED
    retried = F.col("event") == fixed.RETRIED
    requested = F.col("event") == RETRY_REQUESTED
    is_note = F.col("event").isin(NOTES)
    first = F.min_by(
        F.struct("run_id", "error_message", "failed_at"), F.when(detected, order))
    attempts = F.collect_set(F.when(
        detected | retried, F.struct("seq", "run_id", retried.alias("is_retry"))))
    folded = events.groupBy("tracking_id").agg(
        F.max("job_id").alias("job_id"),
        first.alias("_first"),
        F.array_sort(attempts).alias("_attempts"),
        newest("classification"), newest("status"), newest("fix_suggestion"),
        F.max_by("next_retry_at", F.when(~is_note, order)).alias("next_retry_at"),
        F.max(F.when(~is_note, F.col("ts"))).alias("last_updated_at"),
        F.max_by(F.when(requested, F.col("ts")), F.when(requested | retried, order)).alias("requested_at"),
        F.max_by("run_started_at", F.when(retried, order)).alias("run_started_at"),
        F.max("corrected_at").alias("corrected_at"),
        F.max("seq").alias("version"),
        # What a row that is updated has to know: which of its columns these events set.
        F.bool_or(~is_note).alias("_moved"), F.bool_or(requested | retried).alias("_asked"), F.bool_or(retried).alias("_retried"),
    )
    run_ids = F.transform("_attempts", lambda a: a["run_id"])
    return folded.select(
        "tracking_id", "job_id",
        F.col("_first.run_id").alias("original_run_id"),
        F.try_element_at(run_ids, F.lit(-1)).alias("latest_run_id"),
        F.col("_first.error_message").alias("error_message"),
        "classification",
        F.size(F.filter("_attempts", lambda a: a["is_retry"])).alias("retry_count"),
        "status",
        F.col("_first.failed_at").alias("first_failed_at"),
        "last_updated_at",
        F.array_distinct(run_ids).alias("all_run_ids"),
        "next_retry_at", "fix_suggestion", "version", "requested_at", "run_started_at", "corrected_at",
        "_moved", "_asked", "_retried",
    )


def current_state(events: DataFrame) -> DataFrame:
    """The state table as of the events given."""
    rows = reduce_events(events).where(F.col("original_run_id").isNotNull())
    return rows.drop("_moved", "_asked", "_retried")


def state_as_of(events: DataFrame, at: datetime) -> DataFrame:
    """The state table as it was at a time: the log folded up to then, that time included."""
    return current_state(events.where(F.col("ts") <= instant_like(at, events, "ts")))


def run_history(incidents: DataFrame) -> Column:
    """The run ids of a row; a row that was never backfilled has its two known ids."""
    return F.coalesce(
        "all_run_ids", F.array_distinct(F.array("original_run_id", "latest_run_id")))


def backfill_run_ids(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("all_run_ids", run_history(incidents))


def apply_updates(incidents: DataFrame, events: DataFrame, small: bool = False) -> DataFrame:
    """State rows with later events folded in: a keyed update, and rows for incidents
    that the events detect. Events a row contains already are skipped.

    When the events are known to be few, rows they do not touch pass through at the
    scan and only the others are joined.
    """
    base = schemas.evolve(incidents, schemas.INCIDENT_STATE).select(schemas.INCIDENT_STATE.names)
    if not small:
        return _fold(base, events)
    touched = F.broadcast(events.select("tracking_id").distinct())
    folded = _fold(base.join(touched, "tracking_id", "left_semi"), events)
    return folded.unionByName(base.join(touched, "tracking_id", "left_anti"))


def _fold(base: DataFrame, events: DataFrame) -> DataFrame:
    versions = base.select(F.col("tracking_id").alias("_id"), F.col("version").alias("_version"))
    later = events.join(versions, F.col("tracking_id") == F.col("_id"), "left").where(
        F.col("_version").isNull() | (F.col("seq") > F.col("_version"))).drop("_id", "_version")
    base, new = base.alias("b"), reduce_events(later).alias("n")
    none = F.array().cast("array<string>")

    def pick(column: str, *sides: str) -> Column:
        return F.coalesce(*[F.col(f"{side}.{column}") for side in sides]).alias(column)

    def set_by(flag: str, column: str) -> Column:
        return F.when(F.col(f"n.{flag}"), F.col(f"n.{column}")).otherwise(F.col(f"b.{column}")).alias(column)

    history = F.coalesce("b.all_run_ids", F.when(
        F.col("b.tracking_id").isNotNull(),
        F.array_distinct(F.array("b.original_run_id", "b.latest_run_id"))), none)
    folded = base.join(new, F.col("b.tracking_id") == F.col("n.tracking_id"), "full").select(
        pick("tracking_id", "b", "n"),
        pick("job_id", "b", "n"),
        pick("original_run_id", "b", "n"),
        pick("latest_run_id", "n", "b"),
        pick("error_message", "b", "n"),
        pick("classification", "n", "b"),
        (F.coalesce("b.retry_count", F.lit(0)) + F.coalesce("n.retry_count", F.lit(0))).alias("retry_count"),
        pick("status", "n", "b"),
        pick("first_failed_at", "b", "n"),
        F.greatest("b.last_updated_at", "n.last_updated_at").alias("last_updated_at"),
        F.array_union(history, F.coalesce("n.all_run_ids", none)).alias("all_run_ids"),
        set_by("_moved", "next_retry_at"),
        pick("fix_suggestion", "n", "b"),
        F.greatest("b.version", "n.version").alias("version"),
        set_by("_asked", "requested_at"),
        set_by("_retried", "run_started_at"),
        F.greatest("b.corrected_at", "n.corrected_at").alias("corrected_at"),
    )
    return folded.where(F.col("original_run_id").isNotNull())


def rows_by_status(incidents: DataFrame, *statuses: str) -> DataFrame:
    return incidents.where(F.col("status").isin(list(statuses)))
