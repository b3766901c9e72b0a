"""Streams with state per key: runs out of their timeline, and timers of retries."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runmend import fixed, schemas
from runmend.operators.incidents import NOTES
from runmend.settings import Settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(frame: DataFrame) -> None:
    """Keyed state with timers needs this provider; streams started from now on use it."""
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _whole(value: object) -> int | None:
    """A time in microseconds. Times go to Python and back as numbers, whatever the year; a
    column with a null arrives as floats, which hold them exactly."""
    return None if value is None or pd.isna(value) else int(value)


_ENDED = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("start_time", T.LongType()), T.StructField("result_state", T.StringType()),
    T.StructField("task_run_id", T.StringType())])


#: Keys that runs are dealt to where each of them need not be waited for.
BUCKETS = 4096
_PERIOD = ("period_start_time", "period_end_time", "result_state", "task_run_id")
# Of a run: start, time of its result, result, task, and whether it was given out.
_UNSEEN = (None, None, None, None, False)


def _millis(span: timedelta) -> int:
    return int(span.total_seconds() * 1000)


def _with_period(run: tuple, begin: object, end: object, found: object, of_task: object) -> tuple[tuple, int]:
    """A run with one more period, and that period's time."""
    start, result_at, result, task, sent = run
    begin, end = _whole(begin), _whole(end)
    start = begin if start is None else min(start, begin)
    at = begin if end is None else end
    task = of_task if task is None and isinstance(of_task, str) else task
    if isinstance(found, str) and (result_at is None or at > result_at):
        result_at, result = at, found
    return (start, result_at, result, task, sent), at


def _ended(runs: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(runs, columns=_ENDED.names)


class _WaitingRuns(StatefulProcessor):
    """The newest state of a run: its first period's start, and the result of the latest
    period that has one. It is given out once, when the watermark passes its end, and
    forgotten some time after that."""

    def __init__(self, keep: timedelta):
        self.keep = _millis(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, result_at long, result string, task string, sent boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        run, last = (self.run.get() if self.run.exists() else _UNSEEN), 0
        for frame in rows:
            for begin, end, found, of_task in zip(*(frame[c] for c in _PERIOD)):
                run, at = _with_period(run, begin, end, found, of_task)
                last = max(last, at)
        start, result_at, result, task, sent = run
        self.run.update(run)
        # A run that waits comes with the watermark; else the timer only forgets it.
        waiting = result is not None and not sent
        self.handle.registerTimer((result_at if waiting else last) // 1000 + (0 if waiting else self.keep))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        start, result_at, result, task, sent = self.run.get()
        if result is not None and not sent:
            self.run.update((start, result_at, result, task, True))
            self.handle.registerTimer(result_at // 1000 + self.keep)
            yield _ended([(*key, start, result, task)])
        elif timerValues.getCurrentWatermarkInMs() >= max(result_at or 0, start) // 1000 + self.keep:
            self.run.clear()

    def close(self) -> None:
        pass


class _Runs(StatefulProcessor):
    """The same for many runs at once, those whose ids hash alike, which spares most of the
    calls that a key of its own costs each run. A run is given out as soon as its result is
    read. One timer looks after the runs of a key, at a time that is rounded up by a share of
    ``keep``, so that they are not gone through whenever the watermark moves."""

    def __init__(self, keep: timedelta):
        self.keep = _millis(keep)
        self.step = max(self.keep // 24, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState(
            "runs", "job_id string, run_id string",
            "start long, result_at long, result string, task string, sent boolean, forget long")

    def _look_at(self, forget: int) -> None:
        self.handle.registerTimer(-(-forget // self.step) * self.step)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = not self.runs.exists()
        seen: dict[tuple, tuple] = {}
        for frame in rows:
            for job_id, run_id, *period in zip(*(frame[c] for c in ("job_id", "run_id", *_PERIOD))):
                of = (job_id, run_id)
                if of not in seen:
                    kept = None if new else self.runs.getValue(of)
                    seen[of] = (_UNSEEN, 0) if kept is None else (tuple(kept[:5]), kept[5])
                run, forget = seen[of]
                run, at = _with_period(run, *period)
                seen[of] = run, max(forget, at // 1000 + self.keep)
        given = []
        for of, ((start, result_at, result, task, sent), forget) in seen.items():
            if result is not None and not sent:
                given.append((*of, start, result, task))
            self.runs.updateValue(of, (start, result_at, result, task, result is not None, forget))
        if seen:
            self._look_at(min(forget for _, forget in seen.values()))
        if given:
            yield _ended(given)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = [(of, value[5]) for of, value in self.runs.iterator()] if self.runs.exists() else []
        stay = [forget for _, forget in runs if forget > now]
        if stay:
            for of, forget in runs:
                if forget <= now:
                    self.runs.removeKey(of)
            self._look_at(min(stay))
        elif runs:
            self.runs.clear()
        return iter([])

    def close(self) -> None:
        pass


def runs_from_timeline_stream(
    timeline: DataFrame, settings: Settings = Settings(), lateness: str = "10 minutes", wait: bool = True,
) -> DataFrame:
    """Ended runs of a stream of timeline rows (schema ``RUN_TIMELINE``), each once, however
    often its rows come. With ``wait`` a run is given out when the watermark, ``lateness``
    behind, passes its end, so rows that come later than others, but not later than that,
    change nothing; without, as soon as its result is read, dated by the periods seen until
    then. Its state goes a lookback after its last period, without ``wait`` up to a 24th of
    that later."""
    use_rocksdb(timeline)
    rows = timeline.select(
        "job_id", "run_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("period_start_time", "period_end_time")], "result_state",
        F.get("tasks", F.lit(0))["run_id"].alias("task_run_id"),
        F.coalesce("period_end_time", "period_start_time").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", lateness)
    bucket = F.pmod(F.xxhash64("job_id", "run_id"), F.lit(BUCKETS)).cast("int")
    grouped = rows.groupBy("job_id", "run_id") if wait else rows.withColumn("bucket", bucket).groupBy("bucket")
    ended = grouped.transformWithStateInPandas(
        (_WaitingRuns if wait else _Runs)(settings.lookback), outputStructType=_ENDED, outputMode="Append", timeMode="EventTime")
    tasks = F.when(F.col("task_run_id").isNotNull(), F.array(F.struct(F.col("task_run_id").alias("run_id"))))
    return schemas.conform(ended.select(
        "job_id", "run_id", F.timestamp_micros("start_time").alias("start_time"), F.lit(fixed.TERMINATED).alias("life_cycle_state"), "result_state",
        tasks.alias("tasks")), schemas.RUNS)


_DUE = T.StructType([
    T.StructField("tracking_id", T.StringType()), T.StructField("job_id", T.StringType()),
    T.StructField("next_retry_at", T.LongType())])


class _Timers(StatefulProcessor):
    """One timer for each incident, at the time its next retry is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wanted = handle.getValueState("wanted", "job_id string, seq int, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        job, seq, due = self.wanted.get() if self.wanted.exists() else (None, 0, None)
        for frame in rows:
            for job_id, number, event, at in zip(frame["job_id"], frame["seq"], frame["is_note"], frame["next_retry_at"]):
                if not event and number > seq:
                    job, seq, due = job_id, int(number), _whole(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.wanted.update((job, seq, due))
        if due is not None:
            self.handle.registerTimer(max(-(-due // 1000), 0))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        job, seq, due = self.wanted.get()
        if due is not None:
            self.wanted.update((job, seq, None))
            yield pd.DataFrame({"tracking_id": [key[0]], "job_id": [job], "next_retry_at": [due]})

    def close(self) -> None:
        pass


def due_retries(events: DataFrame) -> DataFrame:
    """A stream of the events of incidents to one row for each retry that is due, when the
    clock reaches its recorded time. An event that moves the incident on cancels the timer;
    repeated and older events change nothing. The number of the last event is kept for each
    incident, so that an old one that comes again starts no timer."""
    use_rocksdb(events)
    due = events.select(
        "tracking_id", "job_id", "seq", F.col("event").isin(NOTES).alias("is_note"),
        F.unix_micros(F.col("next_retry_at").cast("timestamp")).alias("next_retry_at"),
    ).groupBy("tracking_id").transformWithStateInPandas(
        _Timers(), outputStructType=_DUE, outputMode="Append", timeMode="ProcessingTime")
    return due.withColumn("next_retry_at", F.timestamp_micros("next_retry_at"))
