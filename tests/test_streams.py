"""Streams: the same incidents as a batch, over several micro-batches and a replay."""

from datetime import datetime, timedelta

from runmend import fixed, schemas
from runmend.settings import Settings
from runmend.plans.cycle import Judgement
from runmend.sources.store import TriageStore
from runmend.sources.tables import stream_table
from runmend.streaming.reactor import react_to_runs, scan_runs_table, take_events

NOW = datetime(2024, 5, 2, 12)
HOUR = timedelta(hours=1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def forget_last_commit(checkpoint):
    """As after a crash between writing a batch and committing it."""
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()


def test_reactor(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "runs"), tmp_path / "checkpoint"
    store = TriageStore(spark, str(tmp_path / "store"))
    outputs = spark.createDataFrame([("t1", "Read timed out", None), ("t3", "Access denied", None)], schemas.RUN_OUTPUTS)
    jobs = spark.createDataFrame([("a", "ann")], schemas.JOBS)

    def run(number, at, result):
        return ("a", str(number), at, "TERMINATED", result, [(f"t{number}",)])

    def react():
        drain(react_to_runs(
            stream_table(spark, folder, schemas.RUNS), lambda: outputs, lambda: jobs, store,
            lambda number: NOW + number * HOUR, str(checkpoint)))

    def tracked():
        return {r.original_run_id: r.status for r in store.state().collect()}

    put(spark, folder, [run(1, NOW - HOUR, "FAILED"), run(1, NOW - HOUR, "FAILED"),
                        run(2, NOW - HOUR, "SUCCESS")], schemas.RUNS)
    react()
    assert tracked() == {"1": "retry_scheduled"}
    # A second file overlaps the first, and holds a run that is older than the lookback.
    put(spark, folder, [run(1, NOW - HOUR, "FAILED"), run(3, NOW, "FAILED"),
                        run(4, NOW - 30 * HOUR, "FAILED")], schemas.RUNS)
    react()
    assert tracked() == {"1": "retry_scheduled", "3": "permanent_no_action"}
    assert store.notifications().count() == 1

    log = sorted(store.events().collect())
    forget_last_commit(checkpoint)
    react()
    assert sorted(store.events().collect()) == log
    assert store.notifications().count() == 1


def test_runs_tracked_elsewhere_between_batches(spark, tmp_path):
    """The tracked ids are read in every micro-batch, not when the stream starts."""
    folder = str(tmp_path / "events")
    store = TriageStore(spark, str(tmp_path / "store"))
    jobs = spark.createDataFrame([], schemas.JOBS)
    scans = []

    def take(writer, checkpoint):
        drain(take_events(
            stream_table(spark, folder, schemas.FAILURE_EVENTS).coalesce(1), lambda: jobs, store,
            lambda number: NOW, str(tmp_path / checkpoint), Judgement(Settings(default_owner="desk")),
            writer=writer, full_scan=scans.append))

    put(spark, folder, [("a", "1", fixed.LABELLED_ERRORS[0][0], None), ("a", "1", "seen later", NOW + HOUR),
                        ("a", "2", "", NOW)], schemas.FAILURE_EVENTS)
    take("one", "c1")
    assert scans == [0]  # an event without text asks for a full scan
    put(spark, folder, [("b", "3", "Access denied to 'x'", NOW - HOUR)], schemas.FAILURE_EVENTS)
    take("two", "c2")  # reads both files; run 1 is tracked by now
    rows = {r.original_run_id: r for r in store.state().collect()}
    assert {k: r.status for k, r in rows.items()} == {"1": "retry_scheduled", "3": "permanent_no_action"}
    assert rows["1"].first_failed_at == NOW and rows["3"].first_failed_at == NOW - HOUR
    assert store.events().where("event = 'detected'").count() == 2
    (notice,) = store.notifications().collect()
    assert (notice.notified_user, notice.error_message) == ("desk", "Access denied to 'x'")


def test_events_without_a_field_lead_to_their_runs(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "events"), tmp_path / "checkpoint"
    store = TriageStore(spark, str(tmp_path / "store"))
    runs = spark.createDataFrame(
        [("a", str(i), NOW - 40 * i * HOUR, "TERMINATED", result, [(f"t{i}",)])
         for i, result in ((1, "FAILED"), (2, "FAILED"), (3, "FAILED"), (4, "SUCCESS"))], schemas.RUNS)
    outputs = spark.createDataFrame([("t2", "Access denied", None)], schemas.RUN_OUTPUTS)
    jobs = spark.createDataFrame([("a", "ann")], schemas.JOBS)

    def take():
        drain(take_events(
            stream_table(spark, folder, schemas.FAILURE_EVENTS), lambda: jobs, store, lambda number: NOW, str(checkpoint),
            full_scan=scan_runs_table(lambda: runs, lambda: outputs, lambda: jobs, store, lambda number: NOW)))

    put(spark, folder, [("a", "1", "Read timed out", NOW), ("a", "2", "", NOW), ("a", None, "text", NOW)], schemas.FAILURE_EVENTS)
    take()
    rows = {r.original_run_id: r for r in store.state().collect()}
    assert {k: (r.error_message, r.first_failed_at) for k, r in rows.items()} == {
        "1": ("Read timed out", NOW), "2": ("Access denied", NOW - 80 * HOUR), "3": (Settings().no_error_text, NOW - 120 * HOUR)}
    log, notices = sorted(store.events().collect()), store.notifications().count()
    forget_last_commit(checkpoint)
    take()
    assert sorted(store.events().collect()) == log and store.notifications().count() == notices
