"""One pass of the triage: plans over a state, one write of their events, and the
notices and retry requests that follow from what was written."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend import fixed, schemas
from runmend.functions.clock import instant
from runmend.functions.strict_json import fix_json
from runmend.operators import incidents as state
from runmend.operators import joins, outcomes, reports, retry
from runmend.operators.classify import Classifier, classify_by_rules, decide
from runmend.operators.detect import detect_new_failures
from runmend.operators.fixes import Suggester, suggest_by_rules
from runmend.operators.notify import notifications, with_owner
from runmend.operators.runs import as_recent, changed_runs, newest_versions
from runmend.session import shared_dir
from runmend.settings import Settings
from runmend.sources.store import EVENTS, NOTICES, RECENT_RUNS, REQUESTS, Attempt, Batch, TriageStore


@dataclass(frozen=True)
class Inputs:
    """What a pass reads: a snapshot of the runs and the tables around it."""

    runs: DataFrame
    run_outputs: DataFrame
    jobs: DataFrame
    monitored: DataFrame | None = None
    retry_acks: DataFrame | None = None
    corrections: DataFrame | None = None


@dataclass(frozen=True)
class Judgement:
    """How texts are labelled and fixes found."""

    settings: Settings = Settings()
    classify: Classifier = classify_by_rules
    suggest: Suggester = suggest_by_rules()

    def events(self, moves: DataFrame, as_of: datetime, with_fixes: bool) -> DataFrame:
        """Events of the moves. Moves with an error text get its label and the status it
        leads to; the others have their status already."""
        decided = decide(self.classify(moves))
        if with_fixes:
            fix = fix_json(F.col("fix"))
            decided = self.suggest(decided).withColumn("fix_suggestion", fix).drop("fix")
        return state.events_of(decided, as_of, self.settings)


def track_failures(
    store: TriageStore, failures: DataFrame, jobs: DataFrame, batch: Batch, as_of: datetime,
    judge: Judgement,
) -> None:
    """Starts tracking reported failures, with fixes and notices."""
    attempt = store.begin(batch, as_of)
    moves = state.begin_tracking(failures, as_of, judge.settings)
    attempt.write(EVENTS, judge.events(moves, as_of, with_fixes=True))
    write_notices(attempt, jobs, judge.settings)
    attempt.commit()


def write_notices(attempt: Attempt, jobs: DataFrame, settings: Settings) -> None:
    """A notification for each incident the batch made permanent, from its events."""
    made = attempt.read(EVENTS).where(
        (F.col("event") == fixed.CLASSIFIED) & (F.col("status") == fixed.PERMANENT_NO_ACTION))
    rows = made.withColumn("fix", F.from_json("fix_suggestion", schemas.FIX))
    attempt.write(NOTICES, notifications(with_owner(rows, jobs, settings), F.col("ts")))


def _started(open_rows: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open rows after the acks, and the rows the acks changed."""
    started = retry.apply_retry_acks(open_rows, acks).checkpoint()
    rest = open_rows.join(started.select("tracking_id"), "tracking_id", "left_anti")
    ahead = started.withColumn("version", F.col("version") + 1).withColumn("requested_at", F.lit(None).cast("timestamp"))
    return rest.unionByName(ahead), started


def _corrected(rows: DataFrame, corrections: DataFrame, as_of: datetime, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Rows after a person's labels, and the moves that the labels make."""
    moves = reports.correction_moves(rows, corrections).checkpoint()
    new = moves.select("tracking_id", "version", "status", "classification", "event", "corrected_at").alias("n")
    old = rows.alias("o").join(new, F.col("o.tracking_id") == F.col("n.tracking_id"), "left")
    now = instant(as_of, T.TimestampType())
    hit = F.col("n.tracking_id").isNotNull()
    moved = F.col("n.event") == state.CORRECTED
    told = {
        "version": F.col("o.version") + hit.cast("int"),
        "status": F.coalesce("n.status", "o.status"),
        "classification": F.coalesce("n.classification", "o.classification"),
        "corrected_at": F.coalesce("n.corrected_at", "o.corrected_at"),
        # The delay starts anew.
        "last_updated_at": F.when(moved, now).otherwise(F.col("o.last_updated_at")),
        "next_retry_at": F.when(moved, state.next_retry(F.col("n.status"), now, settings)).otherwise(F.col("o.next_retry_at")),
    }
    return old.select(*[told[c].alias(c) if c in told else F.col(f"o.{c}") for c in rows.columns]), moves


def latest_runs(
    store: TriageStore, attempt: Attempt, runs: DataFrame, as_of: datetime, settings: Settings,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """The newest runs of each job: those that the store has, and those that the run table
    has since then. Only a store's first look reads the whole table; later ones name the days
    they read: a run is expected in the table within ``lookback`` and ``clock_margin`` of its
    start. With ``jobs``, few, only their runs are looked up, and nothing is written; without,
    what is new is kept with the batch."""
    recent, seen_to = store.recent_runs(without=attempt.batch)
    if jobs is not None:
        runs = joins.keep_keys(runs, jobs, "job_id", small=True)
    fresh = runs if recent is None else changed_runs(runs, recent, seen_to - settings.lookback - settings.clock_margin)
    look = schemas.conform(as_recent(fresh, as_of, settings), schemas.RECENT_RUNS)
    if jobs is None:
        attempt.write(RECENT_RUNS, look)
        look = attempt.read(RECENT_RUNS)
    return look if recent is None else newest_versions(recent.unionByName(look), settings)


def _pass(
    store: TriageStore, inputs: Inputs, as_of: datetime, batch: Batch, judge: Judgement,
    detect: bool, by_time: bool,
) -> None:
    settings = judge.settings
    shared_dir(store.spark)
    notify = settings.notify_on == "all"
    attempt = store.begin(batch, as_of)

    open_rows = store.state(without=batch, statuses=fixed.OPEN_STATUSES)
    if inputs.corrections is not None:
        # Closed incidents are read for labels alone; a person is expected to give few.
        closed = store.state(without=batch, statuses=fixed.TERMINAL_STATUSES)
        few = joins.is_small(inputs.corrections, settings, "tracking_id")
        open_rows = open_rows.unionByName(joins.keep_keys(closed, inputs.corrections, "tracking_id", few))
    open_rows = open_rows.checkpoint()
    moves, told = [], None
    if inputs.retry_acks is not None:
        open_rows, started = _started(open_rows, inputs.retry_acks)
        moves.append(started.select(
            "tracking_id", "job_id", F.col("latest_run_id").alias("run_id"), "version", "status", "run_started_at"))
    if inputs.corrections is not None:
        open_rows, told = _corrected(open_rows, inputs.corrections, as_of, settings)
        open_rows = open_rows.checkpoint()

    if detect:
        known = store.known_run_ids(without=batch, since=as_of - settings.lookback)
        if inputs.retry_acks is not None:
            known = known.unionByName(inputs.retry_acks.select(F.col("new_run_id").alias("run_id")))
        found = detect_new_failures(
            inputs.runs, inputs.run_outputs, known, as_of, settings, inputs.monitored)
        moves.append(state.begin_tracking(found, as_of, settings))

    # Rows that a broken pass left without a label.
    moves.append(state.rows_by_status(open_rows, fixed.DETECTED).select(
        "tracking_id", "job_id", F.col("latest_run_id").alias("run_id"), "version", "error_message"))

    outcome = outcomes.outcome_states(open_rows, inputs.runs, inputs.run_outputs, settings).checkpoint()
    settled = ~F.col("status").eqNullSafe(outcomes.STILL_RUNNING)
    moves.append(outcome.where(settled).drop("retry_count"))

    plan = _plan(store, attempt, open_rows, inputs.runs, retry.in_flight(outcome), as_of, settings, detect, by_time).checkpoint()
    moves.append(plan.where(F.col("action") == fixed.RESOLVED).select(
        "tracking_id", "job_id", "version", F.col("action").alias("status")))
    moves.append(retry.request_notes(plan))

    together = moves[0]
    for more in moves[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    events = judge.events(together, as_of, with_fixes=notify)
    if told is not None:
        # Labelled already, by a person.
        events = events.unionByName(state.events_of(told, as_of, settings))
    attempt.write(EVENTS, events)
    attempt.write(REQUESTS, retry.retry_requests(plan, instant(as_of, T.TimestampType())))
    if notify:
        write_notices(attempt, inputs.jobs, settings)
    attempt.commit()


def _plan(
    store: TriageStore, attempt: Attempt, open_rows: DataFrame, runs: DataFrame, in_flight: DataFrame, as_of: datetime,
    settings: Settings, all_jobs: bool, by_time: bool,
) -> DataFrame:
    """The plan of the open rows. A pass that reads the run table anyway keeps the newest runs
    of all jobs; another one looks for those of the rows that are due, and not at all when
    none is."""
    jobs = None
    if not all_jobs:
        due = (retry.due_rows_by_time if by_time else retry.due_rows)(open_rows, as_of, settings).select("job_id").distinct()
        small = joins.is_small(due, settings)
        if due.isEmpty():
            runs = runs.limit(0)
        jobs = due if small else None
    recent = latest_runs(store, attempt, runs, as_of, settings, jobs)
    return retry.plan_retries(open_rows, recent, as_of, settings, by_time, in_flight, ranked=True)


def run_cycle(
    store: TriageStore, inputs: Inputs, as_of: datetime, number: int,
    judge: Judgement = Judgement(), writer: str = "cycle", by_time: bool = False,
) -> None:
    """Detects, labels and routes new failures, plans retries that are due, and follows
    up on retries that were started.

    The steps act on different statuses, and what one of them writes is not due for another
    in the same pass, so they are planned from one state, and their moves are labelled,
    written and committed together. A job whose retry was started, or requested, gets no
    other run until that one has a result, however late the run table shows it. Repeating a
    pass with its number replaces its rows. One pass at a time works on a store.
    """
    _pass(store, inputs, as_of, Batch(writer, number), judge, detect=True, by_time=by_time)


def run_retries(
    store: TriageStore, inputs: Inputs, as_of: datetime, number: int,
    judge: Judgement = Judgement(), writer: str = "retries", by_time: bool = True,
) -> None:
    """Only what follows from the own state: retries whose recorded time has come, acks,
    corrections and outcomes. It does not look for failures: the run table is read for the
    jobs of rows that are due and on the days that retries started, and not at all when
    there is neither."""
    _pass(store, inputs, as_of, Batch(writer, number), judge, detect=False, by_time=by_time)
