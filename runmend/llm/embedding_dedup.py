"""Near-duplicate vectors by lattice hashing.

Vectors are scaled to length one. Each of ``TABLES`` tables projects them to eight random
directions, where the nearest E8 lattice point is a vector's home cell and the next
``PROBES`` are the neighbours it probes. Vectors whose home another one shares or probes
are compared; a link counts if its cosine, in double precision, reaches the threshold.
For a pair at 0.95 the chance to be missed is about 1 %, less for nearer ones.

Equal vectors are one class from the start, with its number of rows, so a vector that is
everywhere is hashed once. A pair that meets in several tables counts in the first, which
either side's cells tell. A cell with more than ``BLOCK`` homes is dealt to chunks, and
these meet two by two in tasks of their own; probes pass by a chunk in batches. A task
gives a row for each vector it linked (its number of links, and the smallest vector it is
connected to in the cell), not one for each pair.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, as do rows with a null id (their component is null); vectors of
different lengths never meet; rows with one id and different vectors count as two
vectors with one component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmend.llm.common import connected_components, stored
from runmend.llm.e8 import nearest_points
from runmend.llm.shingles import mixed

THRESHOLD = 0.95
TABLES = 8
PROBES = 3
#: Of a cell, in projected lengths: what a lattice step is against a random direction.
WIDTH = 1.0
BLOCK = 2048
BROADCAST_CELLS = 100_000
SEED = 11
_PAIRS = 1 << 15


@cache
def _projection(length: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, length])
    return random.normal(size=(length, 8 * TABLES)) / WIDTH, random.uniform(size=8 * TABLES)


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares stay finite."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cells_of(units: np.ndarray) -> np.ndarray:
    """vector x table x (home, probes...): hashes of the cells."""
    directions, shift = _projection(units.shape[1])
    at = (units @ directions + shift).reshape(-1, 8)
    points = nearest_points(at, 1 + PROBES).reshape(len(units), TABLES, 1 + PROBES, 8)
    key = np.full(points.shape[:3], units.shape[1], np.uint64) + (np.arange(TABLES, dtype=np.uint64) << np.uint64(32))[None, :, None]
    for axis in range(8):
        key = mixed(key * np.uint64(31) + points[..., axis].astype(np.uint64))
    return key.astype(np.int64)


def _by_length(embeddings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, for each length that occurs."""
    lengths = np.array(embeddings.value_lengths())
    values = np.array(embeddings.flatten(), np.float64)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[(ends[rows] - length)[:, None] + np.arange(length)]


def _in_cells(with_vectors: bool):
    """A row for each cell of each vector; without vectors, homes only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for rows, vectors in _by_length(part.column("embedding")):
                    cells = cells_of(unit_vectors(vectors))
                    if not with_vectors:
                        yield pa.RecordBatch.from_arrays([pa.array(cells[:, :, 0].reshape(-1))], names=["cell"])
                        continue
                    n, each = len(rows), TABLES * (1 + PROBES)
                    at = pa.array(np.repeat(rows, each))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)), pa.array(cells.reshape(-1)),
                         pa.array(np.tile(np.arange(1 + PROBES) > 0, n * TABLES)),
                         part.column("rep").take(at), part.column("m").take(at), part.column("embedding").take(at)],
                        names=["at", "cell", "probe", "rep", "m", "embedding"])
    return run


class _Block:
    """The homes of one cell, or of two of its chunks; probes are not kept."""

    def __init__(self, threshold: float, table: int, length: int, two: bool):
        self.threshold, self.table, self.two = threshold, table, two
        self.units = np.zeros((0, length))
        self.rep, self.weight, self.chunk = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, part: pa.RecordBatch, vectors: np.ndarray, probes: bool) -> pa.RecordBatch | None:
        """Compares new members with the homes (and homes with each other): for each one
        linked, its number of links that count here, and the least one it is connected to."""
        units = unit_vectors(vectors)
        rep, weight, chunk = (np.array(part.column(c), np.int64) for c in ("rep", "m", "chunk"))
        known = len(self.rep)
        if not probes:
            self.units = np.concatenate([self.units, units])
            self.rep, self.weight, self.chunk = (np.r_[old, new] for old, new in ((self.rep, rep), (self.weight, weight), (self.chunk, chunk)))
        a, b = np.nonzero(units @ self.units.T >= self.threshold)
        if not probes:
            kept = b < known + a
            if self.two:  # chunks that meet have met themselves elsewhere
                kept &= chunk[a] != self.chunk[b]
            a, b = a[kept], b[kept]
        if not len(a):
            return None
        mine, yours = cells_of(units), cells_of(self.units)
        counts = np.concatenate([self._first_met(mine[x], yours[y], rep[x], self.rep[y], probes)
                                 for x, y in zip(np.split(a, range(_PAIRS, len(a), _PAIRS)), np.split(b, range(_PAIRS, len(b), _PAIRS)))])
        both = np.r_[rep, self.rep]
        x, y = a, b + len(rep)
        size = np.r_[weight, self.weight].astype(np.float64)
        links = np.bincount(x[counts], size[y[counts]], len(both)) + np.bincount(y[counts], size[x[counts]], len(both))
        label, before = both.copy(), None
        while before is None or (label != before).any():
            before = label.copy()
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
        used = np.unique(np.r_[x, y])
        return pa.RecordBatch.from_arrays([pa.array(both[used]), pa.array(links[used].astype(np.int64)), pa.array(label[used])],
                                          names=["rep", "links", "low"])

    def _first_met(self, mine, yours, rep, other, probes: bool) -> np.ndarray:
        """Whether pairs count here: they did not meet in an earlier table, nor do they
        meet from the other side in this one."""
        probed = (mine[:, :, 1:] == yours[:, :, :1]).any(2)
        probing = (yours[:, :, 1:] == mine[:, :, :1]).any(2)
        same = mine[:, :, 0] == yours[:, :, 0]
        counts = ~(same | probed | probing)[:, :self.table].any(1)
        if probes:
            counts &= ~same[:, self.table] & (~probing[:, self.table] | (rep > other))
        return counts


def _compared(threshold: float):
    """Blocks of rows sorted by cell and chunks, homes before probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("at", "cell", "low", "high", "length", "probe")]
            keys = list(zip(*columns))
            begins = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                *cell, probe = keys[begin]
                if cell != key:
                    key, block = cell, _Block(threshold, cell[0], cell[4], cell[2] != cell[3])
                if probe and not len(block.rep):
                    continue
                for start in range(begin, end, 512):
                    part = batch.slice(start, min(512, end - start))
                    (_, vectors), = _by_length(part.column("embedding"))
                    out = block.meet(part, vectors, probe)
                    if out:
                        yield out
    return run


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", embedding_col: str = "embedding",
                      block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{embedding_col}`").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = stored(rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    element = classes.schema["embedding"].dataType.simpleString()

    many = classes.mapInArrow(_in_cells(False), "cell long").groupBy("cell").agg(F.count("*").alias("homes")).where(F.col("homes") > block) \
        .select("cell", F.ceil(F.col("homes") / F.lit(block)).cast("int").alias("chunks"))
    many = stored(many, "full-cells")
    if many.count() <= BROADCAST_CELLS:
        many = F.broadcast(many)
    placed = classes.mapInArrow(_in_cells(True), f"at int, cell long, probe boolean, rep long, m long, embedding {element}") \
        .join(many, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))) \
        .withColumn("chunk", F.when(F.col("probe"), -1).otherwise(F.pmod(F.xxhash64("rep"), F.col("chunks"))).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = placed.withColumns({
        "low": F.when(F.col("probe"), F.col("other")).otherwise(F.least("chunk", "other")),
        "high": F.when(F.col("probe"), F.col("other")).otherwise(F.greatest("chunk", "other")), "length": F.size("embedding")}) \
        .select("at", "cell", "low", "high", "length", "probe", "chunk", "rep", "m", "embedding")
    keys = ("at", "cell", "low", "high", "length")
    linked = stored(dealt.repartition(*keys).sortWithinPartitions(*keys, "probe").mapInArrow(_compared(threshold), "rep long, links long, low long"), "linked")

    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(linked.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vectors")
    known = classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left") \
        .select("embedding", "rep", "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = rows.where(usable).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
