"""Commits, repeats and segments of the store; retries in flight; corrections; reads by day."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runmend import fixed, schemas
from runmend.operators import joins, outcomes, reports, retry, runs as run_ops
from runmend.operators.classify import call_model, classify_dedup
from runmend.operators.detect import with_error_text
from runmend.plans.cycle import Inputs, run_cycle, run_retries
from runmend.settings import Settings
from runmend.sources.store import EVENTS, REQUESTS, Batch, TriageStore
from tests.test_cycle import NAME_ERROR, T0, TIMEOUT, VAGUE, World, minutes


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path / "store")


def events(spark, ids, hours=0):
    at = T0 + timedelta(hours=hours)
    rows = [(i, 1, "detected", at, "a", i, at, "text", None, "detected", None, None, None, None, None, None) for i in ids]
    return spark.createDataFrame(rows, schemas.INCIDENT_EVENTS)


def ids(rows, column="tracking_id"):
    return sorted(r[column] for r in rows.collect())


def test_a_repeat_leaves_its_own_rows(spark, tmp_path):
    store = TriageStore(spark, str(tmp_path / "s"))
    batch = Batch("w", 1)
    for wanted in (["1", "2", "3"], ["4"], [], ["5", "6"]):
        store.append_events(events(spark, wanted), batch)
        assert ids(store.events()) == ids(store.state()) == wanted
        assert ids(store.events(without=batch)) == []
    store.append_events(events(spark, ["7"]), Batch("w", 2))
    store.compact()
    store.append_events(events(spark, ["8"]), batch)  # folded already: what was committed stays
    assert ids(store.state()) == ids(store.events()) == ["5", "6", "7"]


def test_a_broken_try_is_not_read(spark, tmp_path):
    store = TriageStore(spark, str(tmp_path / "s"))
    attempt = store.begin(Batch("w", 1), T0)
    attempt.write(EVENTS, events(spark, ["1"]))
    assert ids(attempt.read(EVENTS)) == ["1"] and ids(store.events()) == [] == ids(store.state())
    again = store.begin(Batch("w", 1), T0)
    again.write(EVENTS, events(spark, ["2"]))
    again.commit()
    assert ids(store.events()) == ["2"]
    store.vacuum()
    assert len(list((tmp_path / "s" / "segments").iterdir())) == 1 and ids(store.events()) == ["2"]


def test_folders_do_not_grow_with_batches(spark, tmp_path):
    store = TriageStore(spark, str(tmp_path / "s"))
    listed = []
    for number in range(1, 13):
        store.append_events(events(spark, [str(number)], number * 24), Batch("w", number))
        if number % 4 == 0:
            store.compact()
            manifest, markers = store._committed()
            listed.append(len(manifest.segments[EVENTS]) + len(markers) + len(store.files.names("commits/w")))
    assert max(listed) <= 5 and len(store.files.names("manifests")) == 2
    assert ids(store.state()) == ids(store.events()) == sorted(map(str, range(1, 13)))
    # Old segments are not even named for a late start; a margin of a day counts as late.
    recent = store.known_run_ids(since=T0 + timedelta(hours=12 * 24))
    assert ids(recent, "run_id") == ["11", "12"] and len(recent.inputFiles()) < len(store.events().inputFiles())
    store.vacuum()
    assert ids(store.state()) == sorted(map(str, range(1, 13)))


def test_an_empty_repeat_of_a_pass_takes_all_back(world, spark):
    world.run("a", "1", minutes(-30), "FAILED", TIMEOUT)
    world.run("a", "2", minutes(-20), "FAILED", NAME_ERROR)
    world.cycle(T0, 1)
    assert (world.store.events().count(), world.store.notifications().count()) == (4, 1)
    world.runs, world.outputs = {"0": ("z", "0", minutes(-9), "TERMINATED", "SUCCESS", None)}, {"t": ("t", None, None)}
    world.cycle(T0, 1)
    assert (world.store.events().count(), world.store.notifications().count(), world.store.retry_requests().count()) == (0, 0, 0)


def test_a_repeated_run_row_is_one_failure(world, spark):
    world.run("a", "1", minutes(-30), "FAILED", NAME_ERROR)
    rows = [*world.runs.values()] * 3
    inputs = Inputs(spark.createDataFrame(rows, schemas.RUNS), spark.createDataFrame([*world.outputs.values()], schemas.RUN_OUTPUTS),
                    spark.createDataFrame([("a", "ann")], schemas.JOBS))
    run_cycle(world.store, inputs, T0, 1)
    assert world.store.events().count() == 2 and world.store.notifications().count() == 1


def test_one_run_of_a_job_at_a_time_while_the_run_table_lags(world):
    """The run of an acked retry shows up two passes late; a request waits for its ack."""
    for run in ("1", "2", "3"):
        world.run("a", run, minutes(-40 + int(run)), "FAILED", TIMEOUT)
    requested = lambda: {r.tracking_id for r in world.store.retry_requests().collect()}
    world.cycle(T0, 1)
    world.cycle(minutes(16), 2)
    (first,) = requested()
    world.cycle(minutes(20), 3)  # no ack yet: the same request again
    assert requested() == {first} and len({r.request_id for r in world.store.retry_requests().collect()}) == 1
    world.acks.append((first, "r9"))
    for number, at in ((4, 24), (5, 40)):
        world.cycle(minutes(at), number)  # started, but not in the run table
        assert requested() == {first} and world.state()["1"].status == "retried"
    world.run("a", "r9", minutes(23), None, state="RUNNING")
    world.cycle(minutes(44), 6)
    assert requested() == {first}
    world.run("a", "r9", minutes(23), "FAILED", NAME_ERROR)
    world.cycle(minutes(60), 7)
    assert world.state()["1"].status == "permanent_no_action" and len(requested()) == 2
    assert reports.illegal_transitions(world.store.events()).count() == 0


def test_a_request_keeps_its_job_from_earlier_failures(spark):
    """An incident that failed earlier but came later does not get a second run."""
    rows = [("old", "a", T0 - timedelta(hours=2), None), ("asked", "a", T0 - timedelta(hours=1), T0), ("free", "b", T0, None)]
    table = spark.createDataFrame([(i, j, "retry_scheduled", at, T0 - timedelta(hours=1), asked, 0, 2) for i, j, at, asked in rows],
                                  "tracking_id string, job_id string, status string, first_failed_at timestamp, last_updated_at timestamp, "
                                  "requested_at timestamp, retry_count int, version int")
    runs = spark.createDataFrame([], schemas.RUNS)
    plan = {r.tracking_id: r.action for r in retry.plan_retries(table, runs, T0).collect()}
    assert plan == {"old": "skip_same_pass", "asked": "retry", "free": "retry"}
    busy = spark.createDataFrame([("a",), ("a",)], "job_id string")
    plan = {r.tracking_id: r.action for r in retry.plan_retries(table, runs, T0, in_flight=busy).collect()}
    assert plan == {"old": "skip_in_progress", "asked": "skip_in_progress", "free": "retry"}


def test_corrections_are_events(world, spark):
    world.run("a", "1", minutes(-30), "FAILED", VAGUE)
    world.run("b", "2", minutes(-20), "FAILED", NAME_ERROR)
    world.run("c", "3", minutes(-10), "FAILED", TIMEOUT)
    world.cycle(T0, 1)
    key = {run: r.tracking_id for run, r in world.state().items()}
    given = [(key["1"], "Permanent", minutes(1)), (key["1"], "Transient", minutes(2)), (key["2"], "Transient", minutes(2)), (key["3"], "Unknown", minutes(2))]

    def executor(at, number, corrections):
        make = spark.createDataFrame
        run_retries(world.store, Inputs(make([*world.runs.values()], schemas.RUNS), make([*world.outputs.values()], schemas.RUN_OUTPUTS),
                                        make([], schemas.JOBS), corrections=make(corrections, schemas.CORRECTIONS)), minutes(at), number)

    executor(20, 1, given)
    rows = world.state()
    assert {k: (r.classification, r.status) for k, r in rows.items()} == {
        "1": ("Transient", "retry_scheduled"), "2": ("Transient", "permanent_no_action"), "3": ("Unknown", "retry_scheduled")}
    # The delay starts anew for the one that goes on; a note changes no time.
    assert rows["1"].next_retry_at == minutes(35) and rows["3"].next_retry_at == minutes(15)
    assert {r.tracking_id for r in world.store.retry_requests().collect()} == {key["3"]}
    executor(36, 2, given)  # the same labels count once
    assert {r.tracking_id for r in world.store.retry_requests().collect()} == {key["1"], key["3"]}
    assert sum(r.event in ("corrected", "label_corrected") for r in world.log()) == 3
    assert reports.illegal_transitions(world.store.events()).count() == 0
    world.store.compact()
    assert {k: (r.classification, r.status) for k, r in world.state().items()}["1"] == ("Transient", "retry_scheduled")


def test_the_executor_reads_no_runs_when_nothing_is_due(world, spark):
    world.run("a", "1", minutes(-30), "FAILED", TIMEOUT)
    world.cycle(T0, 1)
    broken = spark.createDataFrame([*world.runs.values()], schemas.RUNS).withColumn(
        "start_time", F.raise_error(F.lit("read")).cast("timestamp"))
    run_retries(world.store, Inputs(broken, spark.createDataFrame([], schemas.RUN_OUTPUTS), spark.createDataFrame([], schemas.JOBS)), minutes(14), 1)
    assert world.state()["1"].status == "retry_scheduled" and world.store.retry_requests().count() == 0


def test_an_old_row_does_not_widen_the_scan(spark, tmp_path):
    runs = spark.range(200).selectExpr(
        "'a' AS job_id", "CAST(id AS string) AS run_id", "timestamp'2024-01-01' + make_dt_interval(id, 1) AS start_time",
        "'TERMINATED' AS life_cycle_state", "'SUCCESS' AS result_state", "CAST(NULL AS array<struct<run_id string>>) AS tasks")
    runs.withColumn("run_date", F.to_date("start_time")).write.partitionBy("run_date").parquet(str(tmp_path / "runs"))
    table = spark.read.parquet(str(tmp_path / "runs"))

    def row(name, failed, run, started):
        return (name, "a", name, run, "text", "Transient", 1, "retried", failed, failed, [name], None, None, 2, None, started, None)

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = spark.createDataFrame([row("old", day(0), "190", day(190)), row("new", day(180), "180", day(180)), row("open", day(3), "4", None)],
                                 schemas.INCIDENT_STATE)
    states = outcomes.outcome_states(rows, table, spark.createDataFrame([], schemas.RUN_OUTPUTS))
    assert {r.tracking_id: r.status for r in states.collect()} == {"old": "resolved", "new": "resolved", "open": "resolved"}
    days = run_ops.days_of(rows.limit(0), F.col("first_failed_at"))
    assert days == [] and len(outcomes.start_days(rows)) == 3
    read = run_ops.of_days(table, outcomes.start_days(rows), 1)
    assert len(read.inputFiles()) == 200 and read.count() == 9  # files are pruned at run time
    assert "run_date" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_the_merged_runs_read_named_days(spark, tmp_path):
    runs = spark.range(100).selectExpr(
        "'a' AS job_id", "CAST(id AS string) AS run_id", "timestamp'2024-01-01' + make_dt_interval(id) AS start_time",
        "'TERMINATED' AS life_cycle_state", "'SUCCESS' AS result_state")
    runs.withColumn("run_date", F.to_date("start_time")).write.partitionBy("run_date").parquet(str(tmp_path / "runs"))
    table = spark.read.parquet(str(tmp_path / "runs"))
    seen = runs.where("start_time < timestamp'2024-03-01'").withColumn("life_cycle_state", F.expr("if(run_id = '55', 'RUNNING', life_cycle_state)"))
    first = run_ops.as_recent(seen, datetime(2024, 3, 1), Settings())
    fresh = run_ops.changed_runs(table, first, datetime(2024, 4, 1))
    assert ids(fresh, "run_id") == sorted([*map(str, range(91, 100)), "54", "55", "56"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan


@pytest.mark.parametrize("size", [10, 64 << 20])
def test_long_texts_pass_whatever_the_bound(spark, size):
    settings = Settings(broadcast_bytes=size, hot_rows=3)
    text = "x" * 100_000
    rows = spark.range(40).selectExpr("CAST(id AS string) AS run_id", "concat('t', id % 30) AS task_run_id")
    outputs = spark.range(30).selectExpr("concat('t', id) AS task_run_id", f"concat(repeat('x', 100000), id % 7) AS error")
    small = joins.is_small(rows, settings, "run_id", "task_run_id")
    assert small == (size > 10) and not joins.is_small(outputs, Settings(broadcast_bytes=10**6))
    found = with_error_text(rows, outputs, settings, small)
    assert {(r.run_id, r.error_message) for r in found.collect()} == {(str(i), f"{text}{i % 30 % 7}") for i in range(40)}
    assert classify_dedup(found.select("run_id", "error_message"), settings).count() == 40


def test_a_failing_call_is_repeated_in_halves(spark, tmp_path):
    log = tmp_path / "calls"

    def model(texts):
        with log.open("a") as file:
            file.write(f"{len(texts)}\n")
        if "p5" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    prompts = spark.createDataFrame([(f"p{i}",) for i in range(8)], "prompt string").coalesce(1)
    rows = call_model(prompts, "prompt", model, Settings(model_batch=8), keep_going=True).collect()
    assert {r.prompt: r.raw_response for r in rows} == {f"p{i}": None if i == 5 else f"P{i}" for i in range(8)}
    assert sorted(map(int, log.read_text().split())) == [1, 1, 2, 2, 4, 4, 8]
