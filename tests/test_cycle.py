"""Passes over a store: routing, retries, cut-off, replays, compaction."""

from datetime import datetime, timedelta

import pytest

from runmend import fixed, schemas
from runmend.operators import reports
from runmend.operators.classify import model_classifier
from runmend.operators.fixes import suggest_by_model
from runmend.plans.cycle import Inputs, Judgement, run_cycle
from runmend.settings import Settings
from runmend.sources.store import Batch, TriageStore

T0 = datetime(2024, 5, 1, 12)
TIMEOUT = fixed.LABELLED_ERRORS[0][0]
NAME_ERROR = fixed.LABELLED_ERRORS[1][0]
VAGUE = fixed.LABELLED_ERRORS[2][0]


class World:
    """Runs and their outputs, grown between passes; requests are started at once."""

    def __init__(self, spark, root):
        self.spark = spark
        self.store = TriageStore(spark, str(root))
        self.runs, self.outputs, self.acks = {}, {}, []
        self.seen_requests = set()

    def run(self, job, run, at, result, error=None, state="TERMINATED"):
        self.runs[run] = (job, run, at, state, result, [(f"t{run}",)])
        self.outputs[f"t{run}"] = (f"t{run}", error, None)

    def cycle(self, as_of, number, judge=Judgement()):
        make = self.spark.createDataFrame
        inputs = Inputs(
            make(list(self.runs.values()), schemas.RUNS),
            make(list(self.outputs.values()), schemas.RUN_OUTPUTS),
            make([("a", "owner-a"), ("b", None)], schemas.JOBS),
            retry_acks=make(self.acks, schemas.RETRY_ACKS))
        run_cycle(self.store, inputs, as_of, number, judge)

    def start_requested(self, at, results):
        """Starts the run of every new request, as the job service would. ``results``
        gives (result, error) by job."""
        started = []
        for r in self.store.retry_requests().collect():
            if r.request_id not in self.seen_requests:
                self.seen_requests.add(r.request_id)
                run = f"{r.job_id}-r{sum(1 for x in self.runs.values() if x[0] == r.job_id)}"
                result, error = results[r.job_id]
                self.run(r.job_id, run, at, result, error, "RUNNING" if result is None else "TERMINATED")
                self.acks.append((r.tracking_id, run))
                started.append(r.job_id)
        return sorted(started)

    def state(self):
        return {r.original_run_id: r for r in self.store.state().collect()}

    def log(self):
        rows = self.store.events().drop("writer", "batch_no").collect()
        return sorted(rows, key=lambda r: (r.tracking_id, r.seq))


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path / "store")


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_routing_fixes_and_notices(world):
    world.run("a", "1", minutes(-30), "FAILED", TIMEOUT)
    world.run("a", "2", minutes(-20), "FAILED", NAME_ERROR)
    world.run("b", "3", minutes(-10), "FAILED", VAGUE)
    world.run("b", "4", minutes(-5), "FAILED", "")
    world.run("b", "5", minutes(-4), "FAILED", "Table 'it''s {x}' \\ not found")
    world.run("b", "6", minutes(-3), "TIMEDOUT", TIMEOUT)
    world.cycle(T0, 1)
    rows = world.state()
    assert {k: r.status for k, r in rows.items()} == {
        "1": "retry_scheduled", "2": "permanent_no_action", "3": "unknown_flagged",
        "4": "unknown_flagged", "5": "permanent_no_action"}
    assert rows["4"].error_message == fixed.NO_ERROR_TEXT
    assert rows["1"].next_retry_at == minutes(15) and rows["2"].next_retry_at is None
    assert rows["1"].first_failed_at == minutes(-30)
    assert '"root_cause"' in rows["2"].fix_suggestion and rows["1"].fix_suggestion is None
    notices = {r.job_id: r for r in world.store.notifications().collect()}
    assert notices["a"].notified_user == "owner-a"
    assert notices["b"].notified_user == Settings().default_owner
    assert notices["b"].error_message == "Table 'it''s {x}' \\ not found"


def test_no_notices_when_only_events_notify(world):
    world.run("a", "2", minutes(-20), "FAILED", NAME_ERROR)
    world.cycle(T0, 1, Judgement(Settings(notify_on="event")))
    assert world.state()["2"].fix_suggestion is None
    assert world.store.notifications().count() == 0


def test_story_of_four_jobs(world):
    """a fails every retry, b fails its retry for another reason, c has three failures
    and a slow retry, d fails for good."""
    for run, job, error in (("1", "a", TIMEOUT), ("2", "b", TIMEOUT), ("3", "c", TIMEOUT),
                            ("4", "c", TIMEOUT), ("5", "c", TIMEOUT), ("6", "d", NAME_ERROR)):
        world.run(job, run, minutes(-40 + int(run)), "FAILED", error)
    results = {"a": ("FAILED", TIMEOUT), "b": ("FAILED", NAME_ERROR), "c": (None, None)}

    world.cycle(minutes(0), 1)
    assert world.start_requested(minutes(1), results) == []  # not due yet
    world.cycle(minutes(15), 2)
    # Due to the minute, and one retry per job and pass.
    assert world.start_requested(minutes(16), results) == ["a", "b", "c"]

    world.cycle(minutes(31), 3)
    assert world.start_requested(minutes(32), results) == []  # the run of c is still active
    rows = world.state()
    assert {k: r.status for k, r in rows.items()} == {
        "1": "retry_scheduled", "2": "permanent_no_action", "3": "retried",
        "4": "retry_scheduled", "5": "retry_scheduled", "6": "permanent_no_action"}
    # A new label keeps the first text; the new one is in the log and in the notice.
    assert (rows["2"].classification, rows["2"].error_message) == ("Permanent", TIMEOUT)
    assert [r.error_message for r in world.log() if r.tracking_id == rows["2"].tracking_id][-1] == NAME_ERROR
    notices = {r.job_id: r.error_message for r in world.store.notifications().collect()}
    assert notices == {"b": NAME_ERROR, "d": NAME_ERROR}

    # Repeating a pass changes nothing, nor does folding the log into a snapshot.
    log, requests = world.log(), world.store.retry_requests().count()
    world.cycle(minutes(31), 3)
    assert world.log() == log
    assert world.store.notifications().count() == 2
    assert world.store.retry_requests().count() == requests
    world.store.compact()
    assert world.store._marks() == (1, {"cycle": 2})
    assert world.state() == rows
    known = {r.run_id for r in world.store.known_run_ids().collect()}
    assert known == {"1", "2", "3", "4", "5", "6", "a-r1", "b-r1", "c-r3"}
    open_rows = world.store.state(statuses=fixed.OPEN_STATUSES).collect()
    assert {r.original_run_id for r in open_rows} == {"1", "3", "4", "5"}

    # The slow run succeeds: its incident is resolved, and so are the others of the job.
    world.run("c", "c-r3", minutes(16), "SUCCESS")
    world.cycle(minutes(47), 4)
    rows = world.state()
    assert {rows[k].status for k in "345"} == {"resolved"}
    assert world.start_requested(minutes(48), results) == ["a"]
    for number in (5, 6, 7):
        world.cycle(minutes(47 + 16 * (number - 4)), number)
        world.start_requested(minutes(48 + 16 * (number - 4)), results)
    world.store.compact()
    assert world.store._marks() == (2, {"cycle": 6})
    row = world.state()["1"]
    assert (row.status, row.retry_count) == ("max_retries_reached", 3)
    assert row.all_run_ids == ["1", "a-r1", "a-r2", "a-r3"] and row.latest_run_id == "a-r3"
    assert len(world.seen_requests) == 5
    assert reports.illegal_transitions(world.store.events()).count() == 0
    # No run was tracked twice.
    starts = [r.run_id for r in world.log() if r.event in ("detected", "retried")]
    assert len(starts) == len(set(starts)) == len(world.runs)


def test_pass_with_a_model(world):
    def labels(prompts):
        return ['{"classification": "Permanent", "reasoning": "read it", "confidence": "Low"}'
                if p.endswith("odd text") else "no JSON" for p in prompts]

    def repairs(prompts):
        if any("Job b stopped" in p for p in prompts):
            raise RuntimeError("busy")
        return ['{"root_cause": "cause", "fix_steps": ["step"], "prevention": "care"}' for _ in prompts]

    settings = Settings(model_tasks=2)
    judge = Judgement(settings, model_classifier(labels, settings), suggest_by_model(repairs, settings))
    world.run("a", "1", minutes(-30), "FAILED", "odd text")
    world.run("b", "2", minutes(-20), "FAILED", "odd text")
    world.run("b", "3", minutes(-10), "FAILED", TIMEOUT)
    world.cycle(T0, 1, judge)
    rows = world.state()
    assert {k: r.status for k, r in rows.items()} == {
        "1": "permanent_no_action", "2": "permanent_no_action", "3": "unknown_flagged"}
    parse = {r.run_id: r.parse_status for r in world.log() if r.event == "classified"}
    assert parse == {"1": "OK", "2": "OK", "3": "PARSE_FAILED"}
    fixes = {r.job_id: r.fix_suggestion for r in world.store.notifications().collect()}
    assert '"root_cause":"cause"' in fixes["a"] and '"root_cause":"read it"' in fixes["b"]


def test_stranded_detected_row_is_labelled(world):
    world.run("a", "1", minutes(-30), "FAILED", TIMEOUT)
    world.cycle(T0, 1)
    only_detected = world.store.events().where("event = 'detected'").drop("writer", "batch_no")
    other = TriageStore(world.spark, world.store.root + "-broken")
    other.append_events(only_detected, Batch("cycle", 1))
    world.store = other
    world.cycle(minutes(5), 2)
    assert world.state()["1"].status == "retry_scheduled"


def test_null_in_required_column_stops_the_write(world, spark):
    rows = spark.createDataFrame(
        [("x", 1, "detected", T0, None)], "tracking_id string, seq int, event string, ts timestamp, job_id string")
    with pytest.raises(Exception, match="job_id must not be null"):
        world.store.append_events(rows, Batch("cycle", 1))
