"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_ROUNDS  timed rounds after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from runmend import schemas, session
from runmend.operators import classify, detect, outcomes, retry
from runmend.plans.queries import REGISTERED
from runmend.sources import sample_tables as sample
from runmend.sources.tables import read_table

HEADLINE = [
    "detect_new_failures", "plan_retries", "check_outcomes", "classify_rules",
    "classify_dedup", "parse_response", "latest_runs_per_job", "untracked_runs",
    "current_state", "apply_updates", "illegal_transitions", "notification_body", "audit_report",
]


def seconds(query: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    query().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def median(query: Callable[[], DataFrame], rounds: int) -> float:
    seconds(query)
    return statistics.median(seconds(query) for _ in range(rounds))


def on_tables(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """The main operators over stored runs, outputs and incidents, without the time it
    takes to derive these from the events."""

    def stored(name: str, rows: DataFrame, schema: T.StructType) -> DataFrame:
        schemas.conform(rows, schema).write.parquet(f"{folder}/{name}")
        return read_table(spark, f"{folder}/{name}", schema)

    runs = stored("runs", sample.runs(spark, sf_dir), schemas.RUNS)
    outputs = stored("run_outputs", sample.run_outputs(spark, sf_dir), schemas.RUN_OUTPUTS)
    incidents = stored(
        "incidents", sample.incidents(spark, sf_dir).selectExpr("*", "2 AS version"), schemas.INCIDENTS)
    return {
        "detect_new_failures": lambda: detect.detect_new_failures(
            runs, outputs, detect.tracked_runs(incidents), sample.AS_OF),
        "plan_retries": lambda: retry.plan_retries(incidents, runs, sample.AS_OF),
        "check_outcomes": lambda: outcomes.check_outcomes(incidents, runs, outputs),
        "classify_rules": lambda: classify.classify_by_rules(
            outputs.selectExpr("task_run_id", "error AS error_message")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = session.build("runmend-bench", **{
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {
        name: median(lambda: REGISTERED[name](spark, sf_dir), rounds) for name in HEADLINE}
    stored = on_tables(spark, sf_dir, tempfile.mkdtemp(prefix="run-"))
    stored_times = {name: median(query, rounds) for name, query in stored.items()}
    print(json.dumps({
        "metric": "median seconds per headline query, summed",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in times.items()},
        "on_stored_tables": {name: round(value, 3) for name, value in stored_times.items()},
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "rounds": rounds,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
