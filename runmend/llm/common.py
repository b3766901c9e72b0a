"""What several operators share: texts, held-out rows, stored tables, components.

A row whose ``doc_id`` is null counts as held out: nothing is learned from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runmend.sources.tables import written

#: Up to so many edges, the least neighbours of nodes (16 bytes each) are broadcast.
BROADCAST_EDGES = 200_000
#: Bytes of rows that Spark hands to a Python worker at once. Its own bound is 64 MB, which
#: each task holds in the JVM and once more, with what is derived from it, in Python.
BATCH_BYTES = 4 << 20

# Java finds few matches of this in a text whose words stand one space apart.
_LONG_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LONG_SPACE, " ")


def word_count(text: Column) -> Column:
    """The number of runs of characters that are no white space."""
    packed = F.trim(one_space(text))
    spaces = F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit("")))
    return F.when(packed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: one id in five, and rows without one."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(True))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, safe when executors are lost."""
    return written(df, f"llm-{name}")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, or before. Plans read
    this when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int, row: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in as few batches as stay within ``limit`` bytes, counted as in
    ``by_pieces``, a larger batch alone."""
    part: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        here = (pc.sum(pc.binary_length(batch.column(column))).as_py() or 0) + row * batch.num_rows
        if part and size + here >= limit:
            yield pa.concat_batches(part)
            part, size = [], 0
        part.append(batch)
        size += here
    if part:
        yield pa.concat_batches(part)


def by_pieces(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, limit: int = 1 << 21, row: int = 256) -> Callable:
    """A ``mapInArrow`` function that applies ``function`` to slices of about ``limit``
    bytes of text, a longer row alone, counting each row as ``row`` bytes more. This bounds
    what is derived from a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0)) + row
            group = np.cumsum(sizes) // limit
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(sizes) else []
            for start, end in zip(starts, np.r_[starts[1:], len(sizes)]):
                yield function(batch.slice(int(start), int(end - start)))
    return run


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node``, ``component``: for every node of ``edges`` (``a``, ``b``, both long) the
    smallest node reachable.

    Alternates large and small stars, which ends in about log rounds; each round is a
    table in the shared folder. Nothing is collected but one row that tells whether
    the round changed an edge. The centre of a large star has as many edges as its group
    has nodes: its least neighbour is found with partial sums, and given to the edges by
    a join whose other side stands alone, so that Spark can split the centre's edges.
    """
    def star(of: DataFrame) -> DataFrame:
        return stored(of.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def mark(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    def beside(of: DataFrame) -> DataFrame:
        return F.broadcast(of) if now[0] <= BROADCAST_EDGES else stored(of, name)

    current = star(edges)
    before, now = None, mark(current)
    while now != before:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = beside(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = large if now[0] <= BROADCAST_EDGES else stored(large, name)
        lowest = beside(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        current = star(small)
        before, now = now, mark(current)
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
