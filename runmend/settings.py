"""Tunable parameters of the triage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from runmend import fixed


@dataclass(frozen=True)
class Settings:
    lookback: timedelta = timedelta(hours=fixed.LOOKBACK_HOURS)
    runs_per_job: int | None = fixed.RUNS_PER_JOB
    safety_runs_per_job: int = fixed.SAFETY_RUNS_PER_JOB
    retry_delay: timedelta = timedelta(minutes=fixed.RETRY_DELAY_MINUTES)
    max_retries: int = fixed.MAX_RETRIES
    no_error_text: str = fixed.NO_ERROR_TEXT
    default_owner: str = "unassigned"

    # "run_start" dates an incident by the start of its run, "detection" by the pass.
    first_failed_basis: str = "run_start"
    # "event" notifies for failures reported by events only, "all" for every
    # transition into permanent_no_action.
    notify_on: str = "all"

    # How far the clock that dates incidents may be ahead of the one that dates runs.
    clock_margin: timedelta = timedelta(days=1)

    # A side of a join is broadcast only when its rows and the bytes of the columns that are
    # sent, both measured in one job, are at most these. Texts are never hinted: they are
    # joined after both sides are reduced, and AQE decides by the size they have then.
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 << 20
    # Pieces a join key is spread over when its dimension side cannot be broadcast.
    salt_buckets: int = 16
    # A text that occurs more often than this is spread when labels are joined back.
    hot_rows: int = 1_000_000

    # Tasks that call a model at the same time, and texts handed over per call.
    model_tasks: int = 64
    model_batch: int = 256

    def __post_init__(self):
        if self.first_failed_basis not in ("run_start", "detection"):
            raise ValueError(f"first_failed_basis: {self.first_failed_basis!r}")
        if self.notify_on not in ("event", "all"):
            raise ValueError(f"notify_on: {self.notify_on!r}")
