"""Runs out of timelines and timers of retries, in streams and in batch."""

import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql.streaming.stateful_processor import TimerValues

from runmend import schemas
from runmend.operators import runs as run_ops
from runmend.sources.tables import stream_table
from runmend.streaming import timeline
from runmend.streaming.timeline import due_retries, runs_from_timeline_stream

NOW = datetime(2024, 5, 2, 12)


def at(minutes):
    return NOW + timedelta(minutes=minutes)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, name, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
        "checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def period(run, start, end, result=None, task="t"):
    return ("a", run, at(start), None if end is None else at(end), result, [(task + run,)] if task else None)


ROWS = [
    [period("1", 0, 60), period("1", 60, 70, "FAILED"), period("1", 60, 70, "FAILED"), period("2", 5, 10, "SUCCESS"), period("3", 50, None)],
    # The first period of run 4 comes after its last one, and run 1 comes again.
    [period("4", 80, 90, "FAILED"), period("1", 0, 60), period("1", 60, 70, "FAILED")],
    [period("4", 72, 80), period("3", 50, 91), period("9", 300, 300, "SUCCESS")],
    [period("9", 700, 700, "SUCCESS")],
]
WANT = {"1": ("FAILED", at(0)), "2": ("SUCCESS", at(5)), "4": ("FAILED", at(72))}


def test_timeline_in_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    stream = lambda: stream_table(spark, f"{folder}/in", schemas.RUN_TIMELINE)
    for rows in ROWS:
        put(spark, f"{folder}/in", rows, schemas.RUN_TIMELINE)
        drain(runs_from_timeline_stream(stream(), lateness="30 minutes"), "waited", folder)
        drain(runs_from_timeline_stream(stream(), lateness="30 minutes", wait=False), "at_once", folder)
    found = spark.read.parquet(f"{folder}/waited").where("run_id <> '9'").collect()
    assert len(found) == 3 and {r.run_id: (r.result_state, r.start_time) for r in found} == WANT
    assert {r.tasks[0].run_id for r in found} == {"t1", "t2", "t4"}
    at_once = spark.read.parquet(f"{folder}/at_once").where("run_id <> '9'").collect()
    assert sorted(r.run_id for r in at_once) == ["1", "2", "4"]


def test_timeline_in_batch(spark):
    rows = [row for part in ROWS for row in part if row[1] != "9"]
    for order in (rows, rows[::-1], rows * 2):
        got = run_ops.runs_from_timeline(spark.createDataFrame(order, schemas.RUN_TIMELINE)).collect()
        assert {r.run_id: (r.result_state, r.start_time) for r in got if r.result_state} == WANT
        assert {r.run_id: r.life_cycle_state for r in got} == {"1": "TERMINATED", "2": "TERMINATED", "3": "RUNNING", "4": "TERMINATED"}


def test_repeated_runs_count_once(spark):
    rows = [("a", str(i), at(i), "TERMINATED", "FAILED", None) for i in range(7)] + [("a", "6", at(6), "RUNNING", None, None)] * 3
    for runs in (rows, rows[::-1], rows * 3):
        table = spark.createDataFrame(runs, schemas.RUNS)
        assert sorted(r.run_id for r in run_ops.newest_per_job(table, 5).collect()) == ["2", "3", "4", "5", "6"]
        assert {r.result_state for r in run_ops.newest_per_job(table, 5).collect()} == {"FAILED"}
        assert run_ops.newest_per_job(table, None).count() == 7
        assert run_ops.latest_run_status(table).first().result_state == "FAILED"


def test_equal_times_go_by_the_number(spark):
    rows = [("a", run, NOW, "TERMINATED", "FAILED", None) for run in ("999", "1000", "x", "01000", "998")]
    table = spark.createDataFrame(rows, schemas.RUNS)
    assert [run_ops.newest_per_job(table, n).count() for n in (1, 2)] == [1, 2]
    newest = {n: {r.run_id for r in run_ops.newest_per_job(table, n).collect()} for n in range(1, 6)}
    assert newest[1] == {"1000"} and newest[2] == {"1000", "01000"} and newest[3] == newest[2] | {"999"}
    assert newest[4] == newest[3] | {"998"} and run_ops.latest_run_status(table).first().run_id == "1000"


def test_timers(spark, tmp_path):
    folder = str(tmp_path)
    past, future = datetime(2024, 1, 1), datetime(2999, 1, 1)

    def event(incident, seq, name, due=None):
        return (incident, seq, name, NOW, "a", None, None, None, None, None, None, None, None, None, due, None)

    put(spark, f"{folder}/in", [event("other", 1, "detected")], schemas.INCIDENT_EVENTS)
    # Timers of the clock never leave a stream without work, so it is stopped from here.
    query = due_retries(stream_table(spark, f"{folder}/in", schemas.INCIDENT_EVENTS)).writeStream.format("memory") \
        .queryName("due").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(processingTime="1 second").start()

    def take(rows, number):
        put(spark, f"{folder}/in", rows, schemas.INCIDENT_EVENTS)
        until = time.time() + 60
        while time.time() < until and spark.table("due").count() < number:
            time.sleep(0.5)

    try:
        take([event("due", 1, "detected"), event("due", 2, "classified", past), event("later", 2, "classified", future),
              event("moved", 2, "classified", past), event("moved", 3, "resolved"),
              event("noted", 2, "classified", past), event("noted", 3, "retry_requested")], 2)
        take([event("due", 2, "classified", past), event("later", 3, "corrected", past), event("moved", 2, "classified", past)], 3)
        found = spark.table("due").collect()
    finally:
        query.stop()
    assert sorted((r.tracking_id, r.next_retry_at) for r in found) == [("due", past), ("later", past), ("noted", past)]


class CountedState:
    """A map state and a handle that count what is asked of them."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getMapState(self, *schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self._counted(bool(self.kept))

    def getValue(self, key):
        return self._counted(self.kept.get(key))

    def updateValue(self, key, value):
        self._counted(self.kept.__setitem__(key, value))

    def removeKey(self, key):
        self._counted(self.kept.pop(key))

    def clear(self):
        self._counted(self.kept.clear())

    def iterator(self):
        return iter(self._counted(list(self.kept.items())))

    def _counted(self, value):
        self.calls += 1
        return value


def test_many_runs_share_a_key_of_the_state():
    hour, minute, runs = 3_600_000_000, 60_000_000, 1000
    state = CountedState()
    processor = timeline._Runs(timedelta(hours=24))
    processor.init(state)

    def take(*rows):
        frame = pd.DataFrame(rows, columns=["job_id", "run_id", "period_start_time", "period_end_time", "result_state", "task_run_id"])
        parts = processor.handleInputRows((0,), iter([frame[::2], frame[1::2]]), None)
        return sorted(row for part in parts for row in part.itertuples(index=False, name=None))

    def expire(hours):
        assert list(processor.handleExpiredTimer((0,), TimerValues(-1, hours * 3_600_000), None)) == []

    first = [("a", str(i), hour, hour + minute, None, None) for i in range(runs)]
    last = [("a", str(i), hour + minute, hour + 2 * minute, "FAILED", "t") for i in range(runs)]
    assert take(*last, *first) == sorted(("a", str(i), hour, "FAILED", "t") for i in range(runs))
    # One call a run, a timer for all of them.
    assert state.calls <= runs + 5 and len(state.timers) == 1
    assert take(*first, *last) == []
    assert take(("b", "0", 30 * hour, None, None, None)) == []
    expire(25)
    assert len(state.kept) == runs + 1
    expire(26)
    assert list(state.kept) == [("b", "0")] and state.timers[-1] == 54 * 3_600_000
    assert take(("b", "0", 31 * hour, 31 * hour, "SUCCESS", "t")) == [("b", "0", 30 * hour, "SUCCESS", "t")]
    expire(56)
    assert not state.kept
