"""Reports over incidents and their event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runmend import fixed
from runmend.functions.clock import instant_like, utc_clock
from runmend.functions.labels import status_for
from runmend.operators.incidents import CORRECTED, LABEL_CORRECTED, NOTES


def status_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("status").agg(F.count("*").alias("n"))


def recent_incidents(incidents: DataFrame, limit: int = 5) -> DataFrame:
    """The newest incidents."""
    return (
        incidents.select("tracking_id", "job_id", "classification", "status", "retry_count", "first_failed_at")
        .orderBy(F.desc("first_failed_at"), F.desc("tracking_id"))
        .limit(limit)
    )


def job_history(incidents: DataFrame, job_id: str | None = None) -> DataFrame:
    """Incidents of a job, or of every job, newest first."""
    if job_id is not None:
        incidents = incidents.where(F.col("job_id") == job_id)
    return incidents.select(
        "job_id", "first_failed_at", "tracking_id", "original_run_id", "latest_run_id", "status",
    ).orderBy("job_id", F.desc("first_failed_at"), F.desc("tracking_id"))


def incident_by_id(incidents: DataFrame, tracking_id: str) -> DataFrame:
    return incidents.where(F.col("tracking_id") == tracking_id).select(
        "tracking_id", "status", "retry_count", "classification")


def review_queue(incidents: DataFrame) -> DataFrame:
    """Incidents a person has to label."""
    return incidents.where(F.col("status") == fixed.UNKNOWN_FLAGGED)


def escalations(incidents: DataFrame) -> DataFrame:
    """Incidents whose retries are used up."""
    return incidents.where(F.col("status") == fixed.MAX_RETRIES_REACHED)


def label_confusion(labelled: DataFrame) -> DataFrame:
    """Rows per expected and actual label, and whether they agree."""
    agree = F.col("expected").eqNullSafe(F.col("actual"))
    return (
        labelled.groupBy("expected", F.col("classification").alias("actual"))
        .agg(F.count("*").alias("n"))
        .withColumn("outcome", F.when(agree, "PASS").otherwise("FAIL"))
    )


def parse_status_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("parse_status").agg(F.count("*").alias("n"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Status changes that the state machine does not have. One scan and one shuffle: an
    incident has a few events for each of its retries, which a window walks along. Events that
    are repeated count once, notes change nothing, and a gap in the numbers has no status."""
    def allowed(pairs: list) -> Column:
        changes = [f"{a or ''}>{b}" for a, b in pairs]
        return F.concat_ws(">", F.coalesce("from_status", F.lit("")), "to_status").isin(changes)

    along = Window.partitionBy("tracking_id").orderBy("seq")
    steps = events.select("tracking_id", "seq", "event", F.col("status").alias("to_status")) \
        .withColumn("_before", F.lag(F.struct("seq", "to_status")).over(along)) \
        .withColumn("_repeated", F.coalesce(F.col("_before.seq") == F.col("seq"), F.lit(False))) \
        .withColumn("from_status", F.when(F.col("_before.seq") == F.col("seq") - 1, F.col("_before.to_status")))
    legal = allowed(fixed.LEGAL_TRANSITIONS) | (
        (F.col("event") == CORRECTED) & allowed(fixed.LEGAL_TRANSITIONS + fixed.CORRECTION_TRANSITIONS))
    return steps.where(~F.col("_repeated") & ~F.col("event").isin(NOTES) & ~legal).select(
        "tracking_id", "seq", "from_status", "to_status")


def audit_report(incidents: DataFrame) -> DataFrame:
    """Incidents, retries and open incidents per job and label."""
    return incidents.groupBy("job_id", "classification").agg(
        F.count("*").alias("incidents"),
        F.sum(F.col("retry_count").cast("long")).alias("retries"),
        F.count_if(F.col("status").isin(fixed.OPEN_STATUSES)).alias("still_open"),
        F.min("first_failed_at").alias("first_failure"),
        F.max("last_updated_at").alias("last_update"),
    )


def label_lineage(events: DataFrame) -> DataFrame:
    """Every label an incident got, with the one before, in one pass over the log:
    ``tracking_id``, ``seq``, ``ts``, ``event``, ``error_message``, ``label``, ``label_before``,
    ``given_after`` (since the label before)."""
    order = Window.partitionBy("tracking_id").orderBy("seq")
    labels = events.where(F.col("classification").isNotNull()).dropDuplicates(["tracking_id", "seq"])
    return labels.select(
        "tracking_id", "seq", "ts", "event", "error_message", F.col("classification").alias("label"),
        F.lag("classification").over(order).alias("label_before"),
        (F.col("ts") - F.lag("ts").over(order)).alias("given_after"))


def audit_log(events: DataFrame, at: datetime) -> DataFrame:
    """Incidents per job and label as they were at a time, from the log alone: how many,
    their retries, those still open, those whose label was changed and those whose label a
    person gave. The log is read and shuffled once; per job only sums move."""
    upto = events.where(F.col("ts") <= instant_like(at, events, "ts"))
    changes = Window.partitionBy("tracking_id").orderBy("seq")
    label = F.col("classification")
    # The label that held before each event, so that a change is one even after events without label.
    held = F.last(label, ignorenulls=True).over(changes.rowsBetween(Window.unboundedPreceding, -1))
    told = upto.withColumn("_changed", label.isNotNull() & held.isNotNull() & (label != held))
    by_person = F.col("event").isin(CORRECTED, LABEL_CORRECTED)
    order = F.struct("seq", "ts")
    incidents = told.groupBy("tracking_id").agg(
        F.max("job_id").alias("job_id"),
        F.max_by("classification", F.when(label.isNotNull(), order)).alias("classification"),
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"),
        F.count_distinct(F.when(F.col("event") == fixed.RETRIED, F.col("seq"))).alias("retries"),
        F.max(F.col("_changed")).alias("changed"), F.max(by_person).alias("by_person"),
        F.min(F.when(F.col("event") == fixed.DETECTED, F.col("failed_at"))).alias("first_failed_at"),
        F.max(F.when(~F.col("event").isin(NOTES), F.col("ts"))).alias("last_updated_at"))
    return incidents.groupBy("job_id", "classification").agg(
        F.count("*").alias("incidents"), F.sum("retries").alias("retries"),
        F.count_if(F.col("status").isin(fixed.OPEN_STATUSES)).alias("still_open"),
        F.count_if("changed").alias("reclassified"), F.count_if("by_person").alias("corrected"),
        F.min("first_failed_at").alias("first_failure"), F.max("last_updated_at").alias("last_update"))


def newest_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("tracking_id").agg(
        F.max_by("label", F.struct("ts", "label")).alias("corrected"), F.max("ts").alias("corrected_ts"))


def apply_corrections(incidents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Incidents with the newest label a person gave; the status follows the label of
    an incident that is waiting for review."""
    given = F.col("corrected").isNotNull()
    waiting = F.col("status") == fixed.UNKNOWN_FLAGGED
    return (
        incidents.join(newest_corrections(corrections), "tracking_id", "left")
        .withColumn("status", F.when(given & waiting, status_for(F.col("corrected"))).otherwise(F.col("status")))
        .withColumn("classification", F.coalesce("corrected", "classification"))
        .drop("corrected", "corrected_ts")
    )


def correction_moves(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """The events that new corrections make, one for each incident at most.

    A correction counts once: later ones are told by their time. It always becomes the
    label. The status follows only where an incident waits for review, which no automatic
    step does anything to; a label of another incident is a note, and what the pass decides
    by itself about that incident comes after it and stands."""
    met = rows.select("tracking_id", "job_id", "version", F.col("status").alias("_status"), F.col("corrected_at").alias("_before")) \
        .join(newest_corrections(corrections), "tracking_id") \
        .where(F.col("_before").isNull() | (F.col("corrected_ts") > F.col("_before")))
    leads_to = status_for(F.col("corrected"))
    moves_on = (F.col("_status") == fixed.UNKNOWN_FLAGGED) & (leads_to != fixed.UNKNOWN_FLAGGED)
    return met.select(
        "tracking_id", "job_id", "version",
        F.when(moves_on, leads_to).otherwise(F.col("_status")).alias("status"),
        F.col("corrected").alias("classification"),
        F.when(moves_on, CORRECTED).otherwise(LABEL_CORRECTED).alias("event"),
        F.col("corrected_ts").cast("timestamp").alias("corrected_at"))


def model_usage(calls: DataFrame) -> DataFrame:
    """Calls and characters sent and received per day, UTC. ``calls`` has called_at, prompt
    and raw_response."""
    day = F.to_date(utc_clock("called_at", calls.schema["called_at"].dataType))
    return calls.groupBy(day.alias("day")).agg(
        F.count("*").alias("calls"),
        F.sum(F.length("prompt").cast("long")).alias("prompt_chars"),
        F.sum(F.coalesce(F.length("raw_response"), F.lit(0)).cast("long")).alias("response_chars"),
    )
