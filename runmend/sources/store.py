"""The tables the triage writes: append-only, replay-safe, without updates in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend import schemas
from runmend.functions.clock import instant
from runmend.operators import incidents as state, joins
from runmend.operators.runs import newest_versions
from runmend.settings import Settings
from runmend.sources.files import SharedFolder
from runmend.sources.tables import read_table

EVENTS, NOTICES, REQUESTS, RECENT_RUNS = "incident_events", "notifications", "retry_requests", "recent_runs"
SCHEMAS = {
    EVENTS: schemas.EVENT_LOG, NOTICES: schemas.NOTIFICATIONS,
    REQUESTS: schemas.RETRY_REQUESTS, RECENT_RUNS: schemas.RECENT_RUNS}
#: Tables that keep all rows ever committed.
LOGS = (EVENTS, NOTICES, REQUESTS)
#: Segments of a level that are merged into one of the next.
MERGE = 8


@dataclass(frozen=True)
class Batch:
    """Names one write. A writer numbers its batches upwards and may repeat its last."""

    writer: str
    number: int


@dataclass(frozen=True)
class Marker:
    """What a batch committed: a folder, the tables in it, and the times of its events.
    ``order`` is the batch's place among all writers' batches; a repeat keeps it."""

    writer: str
    number: int
    order: int
    path: str
    tables: list[str]
    as_of: str | None = None
    first: int | None = None
    last: int | None = None

    @property
    def batch(self) -> Batch:
        return Batch(self.writer, self.number)


@dataclass(frozen=True)
class Segment:
    """Merged rows of a log: a path, its level and the times of its events."""

    path: str
    level: int
    first: int | None = None
    last: int | None = None


@dataclass(frozen=True)
class Manifest:
    """What compaction left: a snapshot, the last batch of each writer in it, and the
    segments of the logs. Readers name these paths; they do not look for files."""

    version: int = 0
    order: int = 0
    snapshot: str | None = None
    folded: dict[str, int] = field(default_factory=dict)
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    recent_to: str | None = None

    def to_text(self) -> str:
        return json.dumps({**vars(self), "segments": {t: [vars(s) for s in of] for t, of in self.segments.items()}})

    @classmethod
    def of_text(cls, text: str) -> Manifest:
        read = json.loads(text)
        read["segments"] = {t: [Segment(**s) for s in of] for t, of in read["segments"].items()}
        return cls(**read)


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Attempt:
    """One try to write a batch, in a folder of its own. Nothing of it is read by others
    until it is committed; a try that breaks leaves a folder that no marker names."""

    def __init__(self, store: TriageStore, batch: Batch, as_of: datetime | None):
        self.store, self.batch, self.as_of = store, batch, as_of
        self.path = f"segments/{batch.writer}-{batch.number}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def write(self, table: str, rows: DataFrame) -> None:
        # Evenly sized files, whatever the plan's partitions look like.
        checked = schemas.conform(rows, SCHEMAS[table]).hint("rebalance")
        checked.write.parquet(f"{self.store.root}/{self.path}/{table}")
        self.tables.append(table)

    def read(self, table: str) -> DataFrame:
        """What this try wrote."""
        return self.store._read(table, [f"{self.path}/{table}"] if table in self.tables else [])

    def commit(self) -> None:
        """From here on this is the batch, whatever an earlier try of it committed."""
        first, last = self.store._times(self.read(EVENTS)) if EVENTS in self.tables else (None, None)
        self.store._commit(Marker(
            self.batch.writer, self.batch.number, self.store._place(self.batch), self.path, self.tables,
            None if self.as_of is None else self.as_of.isoformat(), first, last))


class TriageStore:
    """Tables under one folder that all executors reach.

    A batch is written to a folder of its own and then committed by one marker file that
    names it; readers follow markers. So all tables of a batch appear together, a repeated
    batch counts with exactly its last rows, fewer or none as they may be, and a batch that
    is folded into a snapshot already keeps what was folded. While a batch is being worked
    on it is left out of what is read: a repeated batch starts from the state the first try
    saw.

    ``compact`` folds old batches into a snapshot of the state and merges their rows into
    segments, ``MERGE`` of a level to one of the next. A manifest names all of it, so what is
    listed is the markers since then, one folder for each writer, and the manifests.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings
        self.files = SharedFolder(spark, self.root)

    # --- writing ---------------------------------------------------------------

    def begin(self, batch: Batch, as_of: datetime | None = None) -> Attempt:
        return Attempt(self, batch, as_of)

    def append_events(self, events: DataFrame, batch: Batch) -> None:
        """A batch of events alone."""
        attempt = self.begin(batch)
        attempt.write(EVENTS, events)
        attempt.commit()

    def _place(self, batch: Batch) -> int:
        manifest, markers = self._committed()
        own = [m.order for m in markers if m.batch == batch]
        return own[0] if own else 1 + max([manifest.order, *(m.order for m in markers)])

    def _commit(self, marker: Marker) -> None:
        tries = [name for name in self.files.names(f"commits/{marker.writer}") if name.startswith(f"{marker.number:019d}-")]
        again = 1 + max((int(name[20:24]) for name in tries), default=0)
        self.files.write(f"commits/{marker.writer}/{marker.number:019d}-{again:04d}.json", json.dumps(vars(marker)))

    # --- reading ---------------------------------------------------------------

    def _committed(self) -> tuple[Manifest, list[Marker]]:
        """The manifest, and the markers after it, the last try of each batch. Markers are
        listed first: one that compaction removes in between is in the manifest then."""
        last: dict[str, dict[str, str]] = {}
        for writer in self.files.names("commits"):
            for name in self.files.names(f"commits/{writer}"):
                last.setdefault(writer, {})[name[:19]] = name
        manifests = self.files.names("manifests")
        manifest = Manifest.of_text(self.files.read(f"manifests/{manifests[-1]}")) if manifests else Manifest()
        markers = [
            Marker(**json.loads(self.files.read(f"commits/{writer}/{name}")))
            for writer, names in last.items() for number, name in sorted(names.items())
            if int(number) > manifest.folded.get(writer, -1)]
        return manifest, markers

    def _read(self, table: str, paths: Iterable[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or SCHEMAS[table]
        paths = [f"{self.root}/{p}" for p in paths]
        return read_table(self.spark, paths, schema) if paths else self.spark.createDataFrame([], schema)

    def _times(self, events: DataFrame) -> tuple[int | None, int | None]:
        row = events.agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")).first()
        return row["first"], row["last"]

    def _log(self, table: str, without: Batch | None = None, since: int | None = None) -> DataFrame:
        """All committed rows; with ``since``, of segments that reach that time or later."""
        manifest, markers = self._committed()
        parts = [(s.path, s.last) for s in manifest.segments.get(table, [])]
        parts += [(f"{m.path}/{table}", m.last) for m in markers if table in m.tables and m.batch != without]
        return self._read(table, [path for path, last in parts if since is None or (last is not None and last >= since)])

    def events(self, without: Batch | None = None) -> DataFrame:
        return self._log(EVENTS, without)

    def notifications(self) -> DataFrame:
        return self._log(NOTICES)

    def retry_requests(self) -> DataFrame:
        return self._log(REQUESTS)

    def _marks(self) -> tuple[int, dict[str, int]]:
        """The newest snapshot and the last batch of each writer in it."""
        manifest, _ = self._committed()
        return manifest.version, manifest.folded

    def _snapshot(self, manifest: Manifest) -> DataFrame:
        # Written by status, so reading open incidents skips the files of closed ones.
        return self._read("incidents", [f"{manifest.snapshot}/incidents"],
                          T.StructType(sorted(schemas.INCIDENT_STATE, key=lambda f: f.name == "status")))

    def state(self, without: Batch | None = None, statuses: list[str] | None = None) -> DataFrame:
        """Current incidents, or those in some statuses: the newest snapshot with the
        later events folded in."""
        manifest, markers = self._committed()
        later = self._read(EVENTS, [f"{m.path}/{EVENTS}" for m in markers if EVENTS in m.tables and m.batch != without])
        if manifest.snapshot is None:
            rows = state.current_state(later)
        else:
            small = joins.is_small(later, self.settings, "tracking_id")
            base = self._snapshot(manifest)
            if statuses is not None:
                # An incident can only leave a closed status by an event.
                moved = later.select("tracking_id").distinct()
                wanted = base.where(F.col("status").isin(statuses))
                others = base.where(~F.col("status").isin(statuses))
                base = wanted.unionByName(joins.keep_keys(others, moved, "tracking_id", small))
            rows = state.apply_updates(base, later, small)
        return rows if statuses is None else state.rows_by_status(rows, *statuses)

    def known_run_ids(self, without: Batch | None = None, since: datetime | None = None) -> DataFrame:
        """Run ids of all histories, for an anti join; no state has to be folded.

        With ``since``, those that runs started since then can have: an event that names a
        run is written after the run started, up to ``clock_margin``, so older segments are
        not read, and older files of the others neither, as events lie in order of time."""
        events = self._log(EVENTS, without, None if since is None else _micros(since - self.settings.clock_margin))
        if since is not None:
            events = events.where(F.col("ts") >= instant(since - self.settings.clock_margin, T.TimestampType()))
        return events.where(F.col("event").isin(state.RUN_EVENTS)).select("run_id")

    def recent_runs(self, without: Batch | None = None) -> tuple[DataFrame | None, datetime | None]:
        """The newest runs of each job as batches have seen them, and the time of the last
        look at the run table; nothing before the first."""
        manifest, markers = self._committed()
        seen = [m for m in markers if RECENT_RUNS in m.tables and m.batch != without]
        paths = [f"{m.path}/{RECENT_RUNS}" for m in seen]
        times = [m.as_of for m in seen if m.as_of]
        if manifest.recent_to is not None:
            paths.append(f"{manifest.snapshot}/{RECENT_RUNS}")
            times.append(manifest.recent_to)
        if not paths:
            return None, None
        return newest_versions(self._read(RECENT_RUNS, paths), self.settings), max(map(datetime.fromisoformat, times))

    # --- compaction --------------------------------------------------------------

    def compact(self) -> None:
        """Folds the log into a new snapshot, without the newest batch, which may still be
        repeated. All writers' batches are folded in the order they came in: one that moves
        an incident on is never folded before the one it builds on. The manifest is written
        last, and only then are the markers taken away that it stands for."""
        manifest, markers = self._committed()
        newest = max((m.order for m in markers), default=0)
        done = [m for m in markers if m.order < newest]
        if not done:
            return
        target = f"snapshots/{manifest.version + 1:09d}-{uuid.uuid4().hex}"
        later = self._read(EVENTS, [f"{m.path}/{EVENTS}" for m in done if EVENTS in m.tables])
        rows = (
            state.current_state(later) if manifest.snapshot is None
            else state.apply_updates(self._snapshot(manifest), later, joins.is_small(later, self.settings, "tracking_id")))
        (
            schemas.conform(rows, schemas.INCIDENT_STATE).hint("rebalance", "status")
            .write.partitionBy("status").parquet(f"{self.root}/{target}/incidents")
        )
        folded = {**manifest.folded, **{m.writer: max(x.number for x in done if x.writer == m.writer) for m in done}}
        merged = Manifest(
            manifest.version + 1, max(m.order for m in done), target, folded,
            {table: self._merged(table, manifest, done, target) for table in LOGS},
            self._recent_folded(manifest, done, target))
        self.files.write(f"manifests/{merged.version:09d}.json", merged.to_text())
        for name in self.files.names("manifests")[:-2]:
            self.files.remove(f"manifests/{name}")
        for writer, last in folded.items():
            for name in self.files.names(f"commits/{writer}"):
                if int(name[:19]) <= last:
                    self.files.remove(f"commits/{writer}/{name}")

    def _merged(self, table: str, manifest: Manifest, done: list[Marker], target: str) -> list[Segment]:
        kept = [*manifest.segments.get(table, [])]
        kept += [Segment(f"{m.path}/{table}", 0, m.first, m.last) for m in done if table in m.tables]
        order = {EVENTS: "ts", NOTICES: "notification_time", REQUESTS: "requested_at"}[table]
        level = 0
        while level <= max((s.level for s in kept), default=-1):
            these = [s for s in kept if s.level == level]
            if these and (level == 0 or len(these) >= MERGE):
                path = f"{target}/{table}-{level + 1}"
                rows = self._read(table, [s.path for s in these])
                rows.repartitionByRange(order).sortWithinPartitions(order).write.parquet(f"{self.root}/{path}")
                times = [(s.first, s.last) for s in these if s.last is not None]
                kept = [s for s in kept if s.level != level] + [Segment(
                    path, level + 1, min((t[0] for t in times), default=None), max((t[1] for t in times), default=None))]
            level += 1
        return kept

    def _recent_folded(self, manifest: Manifest, done: list[Marker], target: str) -> str | None:
        seen = [m for m in done if RECENT_RUNS in m.tables]
        paths = [f"{m.path}/{RECENT_RUNS}" for m in seen]
        paths += [f"{manifest.snapshot}/{RECENT_RUNS}"] if manifest.recent_to else []
        if not paths:
            return None
        rows = newest_versions(self._read(RECENT_RUNS, paths), self.settings)
        schemas.conform(rows, schemas.RECENT_RUNS).hint("rebalance").write.parquet(f"{self.root}/{target}/{RECENT_RUNS}")
        return max([*(m.as_of for m in seen if m.as_of), *([manifest.recent_to] if manifest.recent_to else [])], key=datetime.fromisoformat)

    def vacuum(self) -> None:
        """Removes folders that neither a marker nor the last two manifests name: broken
        tries, replaced ones and merged segments. Run it when no pass and no reader works."""
        manifest, markers = self._committed()
        manifests = [Manifest.of_text(self.files.read(f"manifests/{name}")) for name in self.files.names("manifests")]
        named = {m.path for m in markers} | {s.path.rsplit("/", 1)[0] for m in manifests for of in m.segments.values() for s in of}
        named |= {m.snapshot for m in manifests}
        for top in ("segments", "snapshots"):
            for name in self.files.names(top):
                if f"{top}/{name}" not in named:
                    self.files.remove(f"{top}/{name}")
