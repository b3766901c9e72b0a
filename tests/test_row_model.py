"""The set-based plans against a row-by-row model of the definitions, on random input."""

import random
from datetime import datetime, timedelta

import pytest

from runmend import schemas
from runmend.operators import detect, outcomes, retry
from runmend.settings import Settings

NOW = datetime(2024, 5, 2, 12)
STATES = ["SUCCESS", "FAILED", "FAILED", "CANCELED", "TIMEDOUT", None]
TEXTS = ["Read timed out", "Table not found", "vague", "", None]
LABELS = {"Read timed out": "retry_scheduled", "Table not found": "permanent_no_action"}


def world(seed, jobs=120, span=2000):
    """Jobs with runs at random times of 2000 minutes and incidents of the last ``span``;
    one job has a third of them all."""
    rng = random.Random(seed)
    runs, outputs, incidents = [], {}, []

    def add(job):
        run = f"{len(runs):05d}"
        result = rng.choice(STATES)
        state = "TERMINATED" if result else rng.choice(["RUNNING", "PENDING", "QUEUED"])
        # Whole millis, with many equal times.
        start = NOW - timedelta(minutes=rng.randrange(0, 2000, 25), milliseconds=rng.randrange(2))
        runs.append((job, run, start, state, result, [(f"t{run}",)]))
        outputs[run] = rng.choice(TEXTS)
        return run

    for j in range(jobs):
        for _ in range(rng.randrange(0, 14)):
            add(f"j{j}")
    for _ in range(len(runs) // 2):
        add("hot")
    for i in range(jobs * 2):
        job = "hot" if i % 3 == 0 else f"j{rng.randrange(jobs)}"
        own = [r[1] for r in runs if r[0] == job]
        first = rng.choice(own) if own and rng.random() < 0.5 else f"gone{i}"
        failed = NOW - timedelta(minutes=rng.randrange(0, span, 25))
        latest = rng.choice([r[1] for r in runs if r[2] >= failed] + [f"gone{i}"])
        incidents.append((
            f"i{i:04d}", job, first, latest, "text", "Transient", rng.randrange(5),
            rng.choice(["retry_scheduled", "retry_scheduled", "retried", "resolved"]),
            failed, NOW - timedelta(minutes=rng.randrange(0, 40, 5)),
            [first, latest], None, None, 2))
    return runs, outputs, incidents


def newest(runs, job, limit):
    own = sorted((r for r in runs if r[0] == job), key=lambda r: (r[2], r[1]), reverse=True)
    return own[:limit]


def model_detect(runs, outputs, incidents, limit):
    known = {run for i in incidents for run in i[10]}
    found = {}
    for job in {r[0] for r in runs}:
        for r in newest(runs, job, limit):
            if r[1] in known or r[2] < NOW - timedelta(hours=24) or r[4] != "FAILED":
                continue
            found[r[1]] = outputs[r[1]] or "No error message available"
    return found


def model_retries(runs, incidents):
    """One row after the other; a retry makes its job busy for the rows that follow."""
    actions, busy = {}, set()
    for i in sorted(incidents, key=lambda i: (i[8], i[0])):
        if i[7] != "retry_scheduled":
            continue
        recent = newest(runs, i[1], 10)
        if NOW - i[9] < timedelta(minutes=15):
            actions[i[0]] = "not_due"
        elif any(r[4] == "SUCCESS" and r[2] > i[8] for r in recent):
            actions[i[0]] = "resolved"
        elif any(r[3] in ("RUNNING", "PENDING") for r in recent):
            actions[i[0]] = "skip_in_progress"
        elif i[1] in busy:
            actions[i[0]] = "skip_same_pass"
        else:
            actions[i[0]] = "retry"
            busy.add(i[1])
    return actions


def model_outcomes(runs, outputs, incidents):
    by_id = {r[1]: r for r in runs}
    statuses = {}
    for i in incidents:
        if i[7] != "retried":
            continue
        run = by_id.get(i[3])
        if run is None or run[4] is None:
            statuses[i[0]] = "still_running"
        elif run[4] == "SUCCESS":
            statuses[i[0]] = "resolved"
        elif i[6] >= 3:
            statuses[i[0]] = "max_retries_reached"
        else:
            statuses[i[0]] = LABELS.get(outputs[run[1]], "unknown_flagged")
    return statuses


@pytest.fixture(scope="module", params=[(1, 2000), (2, 2000), (3, 300)])
def tables(spark, request):
    runs, outputs, incidents = world(request.param[0], span=request.param[1])
    frames = (
        spark.createDataFrame(runs, schemas.RUNS),
        spark.createDataFrame([(f"t{r}", e, None) for r, e in outputs.items()], schemas.RUN_OUTPUTS),
        spark.createDataFrame(incidents, schemas.INCIDENTS))
    return (runs, outputs, incidents), frames


BOUNDS = [0, 100_000]


@pytest.mark.parametrize("bound", BOUNDS)
@pytest.mark.parametrize("limit", [1, 5])
def test_detection(tables, bound, limit):
    rows, (runs, outputs, incidents) = tables
    settings = Settings(broadcast_rows=bound, runs_per_job=limit)
    found = detect.detect_new_failures(runs, outputs, detect.tracked_runs(incidents), NOW, settings)
    want = model_detect(*rows, limit)
    assert {r.run_id: r.error_message for r in found.collect()} == want and len(want) > 10


@pytest.mark.parametrize("bound", BOUNDS)
def test_retries(tables, bound):
    rows, (runs, _, incidents) = tables
    plan = retry.plan_retries(incidents, runs, NOW, Settings(broadcast_rows=bound))
    got = {r.tracking_id: r.action for r in plan.collect()}
    want = model_retries(rows[0], rows[2])
    assert got == want
    assert set(want.values()) >= {"not_due", "resolved", "retry", "skip_in_progress"}


def test_same_pass_rows_of_a_hot_job(spark, tables):
    """Without successes and active runs every due row but one of a job waits."""
    rows, (runs, _, incidents) = tables
    quiet = [r for r in rows[0] if r[4] not in ("SUCCESS", None)]
    plan = retry.plan_retries(
        incidents, runs.where("result_state not in ('SUCCESS')"), NOW, Settings(broadcast_rows=0))
    got = {r.tracking_id: r.action for r in plan.collect()}
    assert got == model_retries(quiet, rows[2])
    assert list(got.values()).count("skip_same_pass") > 20


@pytest.mark.parametrize("bound", BOUNDS)
def test_outcomes(tables, bound):
    rows, (runs, outputs, incidents) = tables
    found = outcomes.check_outcomes(incidents, runs, outputs, Settings(broadcast_rows=bound))
    want = model_outcomes(*rows)
    assert {r.tracking_id: r.status for r in found.collect()} == want
    assert len(set(want.values())) == 6
