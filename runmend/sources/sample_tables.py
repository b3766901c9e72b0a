"""Triage tables derived from the ``events`` and ``customer`` tables.

Each event stands for a run of the job named by its user; its type and the number in
``props`` give the run's state and error. Everything is derived lazily over the whole
tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runmend import fixed
from runmend.functions.labels import with_rule_label

AS_OF = datetime(2024, 1, 31)
INCIDENTS_TO = datetime(2024, 1, 30, 12)

# Error text by the last digit of the event's number; the others have none.
ERRORS = {
    0: fixed.LABELLED_ERRORS[0],
    1: fixed.LABELLED_ERRORS[6],
    2: (fixed.NOT_FOUND_ERROR, fixed.PERMANENT),
    3: fixed.LABELLED_ERRORS[1],
    4: fixed.LABELLED_ERRORS[4],
    5: fixed.LABELLED_ERRORS[5],
    6: fixed.LABELLED_ERRORS[3],
    7: fixed.LABELLED_ERRORS[2],
}
# Jobs of this kind of owner are not monitored.
UNMONITORED_TAG = "MACHINERY"


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ntz(value: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def runs_from_events(events: DataFrame) -> DataFrame:
    """runs, with the event's id and number, and the error text as ``raw_error``."""
    errors = " ".join(f"WHEN {digit} THEN {_sql_text(text)}" for digit, (text, _) in ERRORS.items())
    return events.selectExpr(
        "event_id", "ts", "user_id", "event_type", "CAST(get_json_object(props, '$.k') AS int) AS k",
    ).selectExpr(
        "CAST(user_id AS string) AS job_id",
        "CAST(event_id AS string) AS run_id",
        "event_id", "k",
        "ts AS start_time",
        "CASE WHEN event_type = 'view' AND k < 10 THEN 'RUNNING'"
        "     WHEN event_type = 'view' AND k < 15 THEN 'PENDING' ELSE 'TERMINATED' END AS life_cycle_state",
        "CASE WHEN event_type = 'view' AND k < 15 THEN NULL"
        "     WHEN event_type = 'purchase' OR event_type = 'view' AND k >= 60 THEN 'SUCCESS'"
        "     WHEN event_type = 'signup' AND k < 50 THEN 'CANCELED'"
        "     WHEN event_type = 'signup' THEN 'TIMEDOUT' ELSE 'FAILED' END AS result_state",
        # The last digit 9 stands for a run without tasks.
        "CASE WHEN k % 10 <> 9 THEN array(struct(concat('t', event_id) AS run_id)) END AS tasks",
        f"CASE k % 10 {errors} END AS raw_error",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_events(read(spark, sf_dir, "events"))


def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of first tasks; the last digit 8 stands for an empty error text."""
    return runs(spark, sf_dir).where(F.col("tasks").isNotNull()).select(
        F.get("tasks", F.lit(0))["run_id"].alias("task_run_id"),
        F.coalesce("raw_error", F.lit("")).alias("error"),
        F.concat(F.lit("trace of "), F.col("run_id")).alias("error_trace"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per customer; a customer in debt stands for a job without a creator."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("creator_user_name"))


def job_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_mktsegment").alias("tag"))


def monitored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_tags(spark, sf_dir).where(F.col("tag") != UNMONITORED_TAG).select("job_id")


def _with_next_run(rows: DataFrame) -> DataFrame:
    """Adds ``nxt``, the run that follows in the same job. Runs are ranked within an
    hour of a job, so a hot job is not sorted in one task; the last run of an hour is
    followed by the first run of the job's next busy hour."""
    rows = rows.withColumn("hour", F.date_trunc("HOUR", "start_time"))
    in_hour = Window.partitionBy("job_id", "hour").orderBy("start_time", "event_id")
    hours = Window.partitionBy("job_id").orderBy("hour")
    firsts = (
        rows.groupBy("job_id", "hour")
        .agg(F.min(F.struct("start_time", "event_id", "run_id")).alias("first"))
        .select("job_id", "hour", F.lead("first.run_id").over(hours).alias("later"))
    )
    return (
        rows.withColumn("nxt", F.lead("run_id").over(in_hour))
        .join(firsts, ["job_id", "hour"])
        .withColumn("nxt", F.coalesce("nxt", "later"))
        .drop("hour", "later")
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failed runs before ``INCIDENTS_TO`` as incidents in all live states."""
    failed = _with_next_run(runs(spark, sf_dir).drop("tasks")).where(
        (F.col("result_state") == fixed.FAILED) & (F.col("start_time") < ntz(INCIDENTS_TO)))
    labelled = with_rule_label(failed, "raw_error", only_classification=True)
    return labelled.selectExpr(
        "*", "classification = 'Transient' AND event_id % 2 = 1 AND nxt IS NOT NULL AS retried",
    ).selectExpr(
        "*", "CASE WHEN retried THEN nxt ELSE run_id END AS latest_run_id",
    ).selectExpr(
        "run_id AS tracking_id", "job_id", "run_id AS original_run_id", "latest_run_id",
        f"coalesce(raw_error, '{fixed.NO_ERROR_TEXT}') AS error_message",
        "classification",
        "CAST(CASE WHEN retried THEN 1 + event_id % 4 ELSE 0 END AS int) AS retry_count",
        "CASE WHEN classification = 'Permanent' THEN 'permanent_no_action'"
        "     WHEN classification = 'Unknown' THEN 'unknown_flagged'"
        "     WHEN retried THEN 'retried' ELSE 'retry_scheduled' END AS status",
        "start_time AS first_failed_at",
        "start_time + INTERVAL 5 MINUTES AS last_updated_at",
        "array_distinct(array(run_id, latest_run_id)) AS all_run_ids",
    )


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log that leads to ``incidents``: detected, classified, then one retried
    event per retry, 20 minutes apart. Retries are classified again in between, except
    for incidents with four retries, whose log breaks the state machine."""
    rows = incidents(spark, sf_dir)
    attempts = F.filter(F.sequence(F.lit(0), F.col("retry_count")), lambda a: a > 0)
    by_label = (
        F.when(F.col("classification") == fixed.TRANSIENT, fixed.RETRY_SCHEDULED)
        .otherwise(F.col("status")))
    legal = F.col("retry_count") < 4

    def at(minutes: Column) -> Column:
        return F.col("first_failed_at") + F.make_dt_interval(mins=minutes)

    def event(seq: Column, name: str, minutes: Column, run_id: Column, status: Column, label: Column) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(name).alias("event"), at(minutes).alias("ts"),
            run_id.alias("run_id"), status.alias("status"), label.alias("classification"))

    def attempt_run(a: Column) -> Column:
        return F.when(a == F.col("retry_count"), F.col("latest_run_id")).otherwise(
            F.concat("original_run_id", F.lit("-r"), a.cast("string")))

    no_label = F.lit(None).cast("string")
    start = F.array(
        event(F.lit(1), fixed.DETECTED, F.lit(0), F.col("original_run_id"), F.lit(fixed.DETECTED), no_label),
        event(F.lit(2), fixed.CLASSIFIED, F.lit(5), F.col("original_run_id"), by_label,
              F.col("classification")))
    retries = F.transform(attempts, lambda a: event(
        F.when(legal, 1 + 2 * a).otherwise(2 + a), fixed.RETRIED, 5 + 20 * a, attempt_run(a),
        F.lit(fixed.RETRIED), no_label))
    between = F.transform(
        F.filter(attempts, lambda a: legal & (a < F.col("retry_count"))),
        lambda a: event(2 + 2 * a, fixed.CLASSIFIED, 15 + 20 * a, attempt_run(a),
                        F.lit(fixed.RETRY_SCHEDULED), F.lit(fixed.TRANSIENT)))
    return rows.select(
        "tracking_id", "job_id", "error_message",
        F.explode(F.concat(start, retries, between)).alias("e"),
    ).select(
        "tracking_id", "e.seq", "e.event", "e.ts", "job_id", "e.run_id",
        F.when(F.col("e.event") == fixed.DETECTED, F.col("e.ts")).alias("failed_at"),
        F.when(F.col("e.event") == fixed.DETECTED, F.col("error_message")).alias("error_message"),
        "e.classification", "e.status",
        F.when(F.col("e.status") == fixed.RETRY_SCHEDULED, F.col("e.ts") + F.expr("INTERVAL 15 MINUTES"))
        .alias("next_retry_at"),
        F.lit(None).cast("string").alias("fix_suggestion"))


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per failed run: without text where the run has none, undated when the
    number is odd."""
    return failure_events_from_runs(runs(spark, sf_dir))


def failure_events_from_runs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("result_state") == fixed.FAILED).select(
        "job_id", "run_id", F.col("raw_error").alias("error_message"),
        F.when(F.col("k") % 2 == 0, F.col("start_time")).alias("triggered_at"))


def retry_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A started run for every scheduled retry; every third ack repeats a known run."""
    rows = incidents(spark, sf_dir).where(F.col("status") == fixed.RETRY_SCHEDULED)
    number = F.col("original_run_id").cast("long")
    return rows.select("tracking_id", F.when(
        number % 3 == 0, F.col("original_run_id"),
    ).otherwise(F.concat(F.lit("a"), F.col("original_run_id"))).alias("new_run_id"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corrections for each incident in review; the second one counts."""
    rows = incidents(spark, sf_dir).where(F.col("status") == fixed.UNKNOWN_FLAGGED)
    number = F.col("original_run_id").cast("long")
    second = F.when(number % 2 == 0, fixed.TRANSIENT).otherwise(fixed.PERMANENT)
    both = F.array(
        F.struct(F.lit(fixed.UNKNOWN).alias("label"), F.expr("first_failed_at + INTERVAL 1 HOUR").alias("ts")),
        F.struct(second.alias("label"), F.expr("first_failed_at + INTERVAL 2 HOURS").alias("ts")))
    return rows.select("tracking_id", F.explode(both).alias("c")).select("tracking_id", "c.label", "c.ts")


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model response per failed run: mostly plain JSON, and the faults seen in
    practice, by the last digit of the run's number divided by ten."""
    plain = F.concat(
        F.lit('{"classification": "'), "classification",
        F.lit('", "reasoning": "read from the text", "confidence": "High"}'))
    kind = F.floor(F.col("k") / 10)
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 1, F.concat(plain, F.lit(" I hope this helps.")))
        .when(kind == 2, F.lower(plain))
        .when(kind == 3, F.lit('{"reasoning": "no label given"}'))
        .when(kind == 4, F.lit(None).cast("string"))
        .otherwise(plain))
    failed = runs(spark, sf_dir).where(F.col("result_state") == fixed.FAILED).withColumn(
        "error_message", F.coalesce("raw_error", F.lit(fixed.NO_ERROR_TEXT)))
    return with_rule_label(failed, "error_message", only_classification=True).select(
        "run_id", "job_id", "error_message", F.col("start_time").alias("called_at"),
        raw.alias("raw_response"))


# --- the same tables as they come to be ---------------------------------------------

SEEN = datetime(2024, 1, 25)
HISTORY_DELAY_HOURS = 24


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods for each run, the later one first, and the first one twice."""
    periods = F.expr(
        "array(named_struct('a', 1, 'b', 2, 'result_state', result_state), named_struct('a', 0, 'b', 1, 'result_state', NULL), "
        "named_struct('a', 0, 'b', 1, 'result_state', NULL))")
    return runs(spark, sf_dir).select("job_id", "run_id", "start_time", "tasks", F.explode(periods).alias("p")).selectExpr(
        "job_id", "run_id", "start_time + make_dt_interval(0, 0, p.a) AS period_start_time",
        "start_time + make_dt_interval(0, 0, p.b) AS period_end_time", "p.result_state", "tasks")


def tied_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that start at the same time as the others of their day; each is read twice."""
    rows = runs(spark, sf_dir).withColumn("start_time", F.date_trunc("DAY", "start_time").cast("timestamp_ntz"))
    return rows.unionByName(rows)


def earlier_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table as it was at ``SEEN``: every seventh run was active still."""
    active = F.col("event_id") % 7 == 0
    return runs(spark, sf_dir).where(F.col("start_time") < ntz(SEEN)).withColumn(
        "life_cycle_state", F.when(active, "RUNNING").otherwise(F.col("life_cycle_state"))).withColumn(
        "result_state", F.when(~active, F.col("result_state")))


def dated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("run_date", F.to_date("start_time"))


def slow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log up to ``SEEN``, of a triage that waits a day for a retry."""
    due = F.when(F.col("next_retry_at").isNotNull(), F.col("ts") + F.expr(f"INTERVAL {HISTORY_DELAY_HOURS} HOURS"))
    return incident_log(spark, sf_dir).where(F.col("ts") <= ntz(SEEN)).withColumn("next_retry_at", due)


def corrected_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with the later one of the two corrections of each incident in review."""
    second = corrections(spark, sf_dir).groupBy("tracking_id").agg(
        F.max_by("label", "ts").alias("classification"), F.max("ts").alias("ts"))
    log = incident_log(spark, sf_dir)
    of = log.where(F.col("event") == fixed.DETECTED).select("tracking_id", "job_id")
    given = of.join(second, "tracking_id").selectExpr(
        "tracking_id", "3 AS seq", "'corrected' AS event", "ts", "job_id", "classification",
        "CASE classification WHEN 'Transient' THEN 'retry_scheduled' ELSE 'permanent_no_action' END AS status")
    return log.unionByName(given, allowMissingColumns=True)
