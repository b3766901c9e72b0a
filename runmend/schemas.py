"""Schemas of the tables the triage reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUNS = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("start_time", T.TimestampType(), False),
    T.StructField("life_cycle_state", T.StringType(), False),
    T.StructField("result_state", T.StringType()),
    T.StructField("tasks", T.ArrayType(T.StructType([T.StructField("run_id", T.StringType())]))),
])

# A row for each period of a run, as they are written; rows may repeat and come late.
RUN_TIMELINE = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("period_start_time", T.TimestampType(), False),
    T.StructField("period_end_time", T.TimestampType()),
    T.StructField("result_state", T.StringType()),
    T.StructField("tasks", T.ArrayType(T.StructType([T.StructField("run_id", T.StringType())]))),
])

# The newest runs of each job, as a pass saw them at ``seen_at``.
RECENT_RUNS = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("start_time", T.TimestampType(), False),
    T.StructField("life_cycle_state", T.StringType(), False),
    T.StructField("result_state", T.StringType()),
    T.StructField("seen_at", T.TimestampType(), False),
])

RUN_OUTPUTS = T.StructType([
    T.StructField("task_run_id", T.StringType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("error_trace", T.StringType()),
])

JOBS = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("creator_user_name", T.StringType()),
])

MONITORED_JOBS = T.StructType([T.StructField("job_id", T.StringType(), False)])

FAILURE_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("triggered_at", T.TimestampType()),
])

INCIDENTS = T.StructType([
    T.StructField("tracking_id", T.StringType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("original_run_id", T.StringType(), False),
    T.StructField("latest_run_id", T.StringType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("retry_count", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("first_failed_at", T.TimestampType(), False),
    T.StructField("last_updated_at", T.TimestampType(), False),
    T.StructField("all_run_ids", T.ArrayType(T.StringType())),
    T.StructField("next_retry_at", T.TimestampType()),
    T.StructField("fix_suggestion", T.StringType()),
    # Number of the newest event folded into the row; the next event gets version + 1.
    T.StructField("version", T.IntegerType(), False),
])

# What a store knows of an incident besides; tables without these columns do as well.
INCIDENT_STATE = T.StructType([
    *INCIDENTS,
    # When the retry that is wanted now was first requested; null before, and once it started.
    T.StructField("requested_at", T.TimestampType()),
    # When the latest retry's run started, where its ack said so.
    T.StructField("run_started_at", T.TimestampType()),
    # The time of the newest label that a person gave.
    T.StructField("corrected_at", T.TimestampType()),
])

# One row per change of an incident. ``seq`` numbers the events of an incident
# 1, 2, 3, ... so the predecessor of an event is found by an equi join.
INCIDENT_EVENTS = T.StructType([
    T.StructField("tracking_id", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("run_id", T.StringType()),
    T.StructField("failed_at", T.TimestampType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("parse_status", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("next_retry_at", T.TimestampType()),
    T.StructField("fix_suggestion", T.StringType()),
])

# Events as a store keeps them; logs without these columns do as well.
EVENT_LOG = T.StructType([
    *INCIDENT_EVENTS,
    # When a retry's run started, and when a person gave the label.
    T.StructField("run_started_at", T.TimestampType()),
    T.StructField("corrected_at", T.TimestampType()),
])

NOTIFICATIONS = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("notified_user", T.StringType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("ai_reasoning", T.StringType()),
    T.StructField("fix_suggestion", T.StringType()),
    T.StructField("notification_time", T.TimestampType(), False),
])

RETRY_REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("tracking_id", T.StringType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("requested_at", T.TimestampType(), False),
])

RETRY_ACKS = T.StructType([
    T.StructField("tracking_id", T.StringType(), False),
    T.StructField("new_run_id", T.StringType(), False),
])

# With the start of the run, if the service tells it.
DATED_ACKS = T.StructType([*RETRY_ACKS, T.StructField("started_at", T.TimestampType())])

CORRECTIONS = T.StructType([
    T.StructField("tracking_id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
])

FIX = T.StructType([
    T.StructField("root_cause", T.StringType()),
    T.StructField("fix_steps", T.ArrayType(T.StringType())),
    T.StructField("prevention", T.StringType()),
])


def _conformed(field: T.StructField, present: bool) -> str:
    kind = field.dataType.simpleString()
    if not present:
        return f"CAST(NULL AS {kind}) AS {field.name}"
    if field.nullable:
        return f"CAST({field.name} AS {kind}) AS {field.name}"
    stop = f"CAST(raise_error('{field.name} must not be null') AS {kind})"
    return f"coalesce(CAST({field.name} AS {kind}), {stop}) AS {field.name}"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types: absent nullable columns are added
    as null, extra columns dropped, and a null in a NOT NULL column stops the write."""
    missing = [f.name for f in schema if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"missing NOT NULL columns: {', '.join(missing)}")
    return df.selectExpr(*[_conformed(f, f.name in df.columns) for f in schema])


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` it lacks added as nulls; a column that is
    there already is left as it is."""
    return df.selectExpr("*", *[_conformed(f, False) for f in schema if f.name not in df.columns])
