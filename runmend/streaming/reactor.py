"""Streams: each failed run once as it arrives, and failure events one by one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from runmend.functions.clock import instant, instant_like
from runmend.operators import joins
from runmend.operators.detect import (
    event_failures, is_valid_event, untracked, with_error_text, within_lookback)
from runmend.operators.runs import failed_runs, scan_runs
from runmend.plans.cycle import Judgement, track_failures
from runmend.settings import Settings
from runmend.sources.store import Batch, TriageStore

# The time of a micro-batch, by its number; replays must give the same time again.
Clock = Callable[[int], datetime]


def _lookback(settings: Settings) -> str:
    return f"{int(settings.lookback.total_seconds())} seconds"


def failed_in(runs: DataFrame) -> DataFrame:
    return failed_runs(scan_runs(runs)).withColumn("start_time", F.col("start_time").cast("timestamp"))


def failed_once(runs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Failed runs of a stream, each run id once. State is dropped when the watermark,
    one lookback behind, passes it; so are runs older than that, which are too old to be
    tracked where only recent ones are."""
    return failed_in(runs).withWatermark("start_time", _lookback(settings)).dropDuplicatesWithinWatermark(["run_id"])


def _track_runs(
    store: TriageStore, failed: DataFrame, run_outputs: DataFrame, jobs: DataFrame, batch: Batch,
    as_of: datetime, judge: Judgement,
) -> None:
    """Tracks failed runs that are not tracked, each run id once."""
    settings = judge.settings
    rows = failed.drop("life_cycle_state", "result_state").dropDuplicates(["run_id"]).checkpoint()
    small, first = joins.measure(rows, "start_time", settings, "run_id", "task_run_id")
    if first is None:
        return
    found = untracked(rows, store.known_run_ids(without=batch, since=first), small)
    since = instant_like(first, rows, "start_time")
    texts = with_error_text(found, run_outputs, settings, small, since)
    track_failures(store, texts, jobs, batch, as_of, judge)


def react_to_runs(
    runs: DataFrame, run_outputs: Callable[[], DataFrame], jobs: Callable[[], DataFrame],
    store: TriageStore, clock: Clock, checkpoint: str, judge: Judgement = Judgement(),
    writer: str = "reactor", only_recent: bool = True,
) -> DataStreamWriter:
    """A writer that tracks failed runs as they arrive. Start it with a trigger of choice.

    Tracked run ids, outputs and jobs are read anew in every micro-batch: a side table
    joined into the stream's plan would stay as it was when the stream started. With
    ``only_recent`` off, runs count however late they come: there is no watermark, and
    repeats are told by the run ids of the micro-batch and those tracked.
    """
    settings = judge.settings

    def track(batch_rows: DataFrame, number: int) -> None:
        batch, as_of = Batch(writer, number), clock(number)
        rows = within_lookback(batch_rows, as_of, settings) if only_recent else batch_rows
        _track_runs(store, rows, run_outputs(), jobs(), batch, as_of, judge)

    return (
        (failed_once(runs, settings) if only_recent else failed_in(runs)).writeStream.foreachBatch(track)
        .option("checkpointLocation", checkpoint)
    )


def scan_runs_table(
    runs: Callable[[], DataFrame], run_outputs: Callable[[], DataFrame], jobs: Callable[[], DataFrame],
    store: TriageStore, clock: Clock, judge: Judgement = Judgement(), writer: str = "full_scan",
) -> Callable[[int], None]:
    """A ``full_scan`` for ``take_events``: tracks every failed run of the table that is not
    tracked, however old, in the same store. Repeating a number rewrites the same rows."""

    def scan(number: int) -> None:
        _track_runs(store, failed_in(runs()), run_outputs(), jobs(), Batch(writer, number), clock(number), judge)

    return scan


def take_events(
    events: DataFrame, jobs: Callable[[], DataFrame], store: TriageStore, clock: Clock,
    checkpoint: str, judge: Judgement = Judgement(), writer: str = "intake",
    full_scan: Callable[[int], None] | None = None,
) -> DataStreamWriter:
    """A writer that tracks failures reported by events. A micro-batch with an event
    that lacks a field also calls ``full_scan`` with its number."""

    def track(batch_rows: DataFrame, number: int) -> None:
        batch, as_of = Batch(writer, number), clock(number)
        now = instant(as_of, T.TimestampType())
        first = F.min_by(
            F.struct("job_id", "error_message", "start_time"),
            F.struct("start_time", "job_id", "error_message"))
        reported = event_failures(batch_rows, now).groupBy("run_id").agg(first.alias("_first"))
        reported = reported.select("run_id", "_first.*")
        reported = reported.checkpoint()
        small = joins.is_small(reported, judge.settings, "run_id")
        found = untracked(reported, store.known_run_ids(without=batch), small)
        track_failures(store, found, jobs(), batch, as_of, judge)
        if full_scan is not None and not batch_rows.where(~is_valid_event()).isEmpty():
            full_scan(number)

    return events.writeStream.foreachBatch(track).option("checkpointLocation", checkpoint)
