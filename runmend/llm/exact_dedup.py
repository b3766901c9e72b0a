"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their text. A bucket that outgrows its memory
is written to spill files by further bits of the hash, and each file is treated as a
bucket of its own, until a bucket fits an open-addressing table. The table compares
whole texts; the hash only finds the slot.

Spark does the first dealing. Before it, the same routine runs over each input
partition, so a text that makes up a third of the corpus is shuffled once per partition
at most. Spill files are private to a task, and go with it.

Texts are compared after replacing each run of white space by one space. Defined cases:
null text counts as empty; an empty table gives an empty result; of a group, exactly one
row is ``kept``, one with the smallest id (rows repeated with the same id are copies like
any other); null ids come after all others, and a group of null ids only has a null
``keep_id`` and keeps one row. Other columns are not read.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmend.llm.common import one_space, stored

#: Bytes of text, ids and slots that a table may hold before it is split.
MEMORY = 96 << 20
FAN_OUT = 16
#: Up to so many row numbers (8 bytes each) are broadcast.
BROADCAST_ROWS = 2_000_000
_ENTRY_BYTES = 200


class Entry:
    """A text with the ids found for it so far."""

    __slots__ = ("hash", "text", "ids", "weight")

    def __init__(self, hash_: int, text: str, ids: list, weight: int):
        self.hash, self.text, self.ids, self.weight = hash_, text, ids, weight


class OpenTable:
    """Open addressing with linear probing; equal means equal texts."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.entries: list[Entry] = []
        self.bytes = 0

    def _slot(self, hash_: int, text: str) -> int:
        mask = len(self.slots) - 1
        at = (hash_ ^ (hash_ >> 32)) & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry.hash == hash_ and entry.text == text:
                break
            at = (at + 1) & mask
        return at

    def add(self, record: Entry) -> None:
        at = self._slot(record.hash, record.text)
        if (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            entry.ids += record.ids
            entry.weight += record.weight
            self.bytes += 40 * len(record.ids)
            return
        self.slots[at] = len(self.entries)
        self.entries.append(record)
        self.bytes += _ENTRY_BYTES + 40 * len(record.ids) + 2 * len(record.text)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for number, entry in enumerate(self.entries):
            self.slots[self._slot(entry.hash, entry.text)] = number


def grace(records: Iterator[Entry], memory: int = MEMORY, level: int = 0) -> Iterator[Entry]:
    """One entry per different text of ``records``.

    Splitting stops where it can't help: at one text, or when the hash has no bits left
    (only different texts with equal 64-bit hashes get there).
    """
    table = OpenTable()
    for record in records:
        table.add(record)
        if table.bytes > memory and len(table.entries) > 1 and level < 16:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [Path(folder, str(i)) for i in range(FAN_OUT)]
        files = [p.open("wb") for p in paths]
        def spill(entry: Entry) -> None:
            bits = (entry.hash >> (4 * level)) & (FAN_OUT - 1)
            pickle.dump((entry.hash, entry.text, entry.ids, entry.weight), files[bits], protocol=5)
        try:
            for entry in table.entries:
                spill(entry)
            del table
            for record in records:
                spill(record)
        finally:
            for file in files:
                file.close()
        for path in paths:
            yield from grace(_read(path), memory, level + 1)
            path.unlink()


def _read(path: Path) -> Iterator[Entry]:
    with path.open("rb") as file:
        while file.peek(1):
            yield Entry(*pickle.load(file))


def _unsigned(value: int) -> int:
    return value & 0xFFFFFFFFFFFFFFFF


def _local_groups(memory: int):
    """Rows of a partition to one row per different text, with all its ids."""
    schema = pa.schema([("local", pa.int64()), ("hash", pa.int64()), ("text", pa.string()),
                        ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Entry]:
            for batch in batches:
                for hash_, text, doc_id in zip(*(batch.column(c).to_pylist() for c in ("hash", "text", "doc_id"))):
                    yield Entry(_unsigned(hash_), text, [doc_id], 1)

        number = TaskContext.get().partitionId() << 33
        for part in _chunks(grace(records(), memory)):
            yield pa.RecordBatch.from_arrays([
                pa.array(range(number, number + len(part)), pa.int64()),
                pa.array([e.hash - (1 << 64) if e.hash >> 63 else e.hash for e in part], pa.int64()),
                pa.array([e.text for e in part], pa.string()),
                pa.array([sorted(e.ids, key=lambda i: (i is None, i)) for e in part], pa.list_(pa.int64())),
            ], schema=schema)
            number += len(part)
    return run


def _chunks(entries: Iterator[Entry], limit: int = 8 << 20) -> Iterator[list[Entry]]:
    part: list[Entry] = []
    size = 0
    for entry in entries:
        part.append(entry)
        size += len(entry.text) + 8 * len(entry.ids)
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _whole_groups(memory: int):
    """Local groups that share a text: each gets the group's first id and its size. The
    ids of an entry are those of local groups here, one per input partition at most."""
    schema = pa.schema([("local", pa.int64()), ("first_local", pa.int64()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Entry]:
            for batch in batches:
                for hash_, text, local, low, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "text", "local", "low", "n"))):
                    yield Entry(_unsigned(hash_), text, [(low is None, low, local)], n)

        for part in _chunks(grace(records(), memory)):
            first = [min(e.ids, key=lambda i: (i[0], i[1] or 0, i[2])) for e in part]
            sizes = [len(e.ids) for e in part]
            yield pa.RecordBatch.from_arrays([
                pa.array([i[2] for e in part for i in e.ids], pa.int64()),
                pa.array([f[2] for f, s in zip(first, sizes) for _ in range(s)], pa.int64()),
                pa.array([f[1] for f, s in zip(first, sizes) for _ in range(s)], pa.int64()),
                pa.array([e.weight for e, s in zip(part, sizes) for _ in range(s)], pa.int64()),
            ], schema=schema)
    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row.

    The shuffles: one of the different texts of each partition, then two of ids.
    """
    text = one_space(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("hash", F.xxhash64("text"))
    local = stored(rows.mapInArrow(
        _local_groups(memory), "local long, hash long, text string, ids array<long>"), "local-groups")
    groups = local.select("local", "hash", "text", F.element_at("ids", 1).alias("low"), F.size("ids").cast("long").alias("n")) \
        .repartition("hash") \
        .mapInArrow(_whole_groups(memory), "local long, first_local long, keep_id long, group_size long")
    members = local.select("local", "ids", F.sha2("text", 256).alias("text_sha256"))
    joined = members.join(groups, "local")
    return joined.select("*", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id", "keep_id", "group_size",
        ((F.col("at") == 0) & (F.col("local") == F.col("first_local"))).alias("kept"), "text_sha256")


def _row_ids(rows: DataFrame) -> DataFrame:
    """``rows``, read from files, with ``row``: the number of its file, then its place there.
    The files are listed by the driver anyway, a short name each."""
    names = [r[0] for r in rows.select(F.col("_metadata.file_path").alias("name")).distinct().orderBy("name").collect()]
    listed = pa.table({"number": pa.array(range(len(names)), pa.int64()), "name": pa.array(names, pa.string())})
    numbers = rows.sparkSession.createDataFrame(listed)  # rows of a list would take Python workers of their own
    placed = rows.withColumns({"_place": F.struct(F.col("_metadata.file_path").alias("name"), F.col("_metadata.row_index").alias("at"))})
    joined = placed.join(F.broadcast(numbers), F.col("_place.name") == F.col("name"))
    return joined.withColumn("_row", F.shiftleft("number", 40) + F.col("_place.at")).drop("number", "name", "_place")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of ``docs`` that are the first of their texts, with all their columns, whatever
    these are called. Of rows that share id and text, one stays.

    Rows are told apart by their file and place in it; what is no table of files is written
    first. Groups are found among row numbers and texts; ids join them in a narrow table,
    and the rows to drop are taken out of a second scan by their number."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    try:
        marked = _row_ids(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "_metadata"))
    except AnalysisException:
        marked = _row_ids(stored(inner, "rows").select("_all", "_metadata"))
    marked = marked.select("_all", "_row")
    doc_id, text = F.col("_all")[id_col], F.col("_all")[text_col]
    groups = exact_groups(marked.select(F.col("_row").alias("doc_id"), text.alias("text")), memory=memory)
    many = stored(groups.where("group_size > 1").select(F.col("doc_id").alias("row"), "keep_id"), "copies")
    ids = many.join(marked.select(F.col("_row").alias("row"), doc_id.cast("long").alias("id")), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"]
    stays = ids.groupBy("keep_id").agg(first.alias("row"))
    drop = stored(many.select("row").join(stays.select("row"), "row", "left_anti"), "dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return marked.join(drop, F.col("_row") == F.col("row"), "left_anti").select("_all.*")
