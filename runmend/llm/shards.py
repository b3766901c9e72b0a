"""Shards by a Feistel permutation of global row numbers.

Rows are numbered by id, size and checksum: sorted ranges are written once, the ranges'
row counts (one number each) give their offsets. A keyed Feistel network over the
smallest power of two that holds the numbers permutes them; numbers that fall outside
the table walk on through the network until they are inside, which keeps it a
permutation. Position ``p`` then lies in shard ``p % shards`` at slot ``p // shards``, so
shard sizes differ by one row at most, slots have no gaps, and :func:`position` and
:func:`row_at` compute either from the other without the table.

Defined cases: null text has size 16 and checksum 0; null ids come first; rows repeated
whole share all keys, so which copy gets which of their numbers cannot be told; an empty
table gives an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend.llm.common import stored

SHARDS = 40
SEED = 20240131
ROUNDS = 6
RANGES_SORTED_BY = ("doc_id", "text_crc32", "size")


def _mix(value: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, used as the network's round function."""
    x = value.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * ROUNDS + i], np.uint64), 0x9E3779B97F4A7C15)[0]) for i in range(ROUNDS)]


def _network(values: np.ndarray, n_rows: int, seed: int, back: bool) -> np.ndarray:
    """One pass over ``bits`` bits; the two halves swap widths every round."""
    bits = max(2, (n_rows - 1).bit_length())
    widths = (np.uint64(bits // 2), np.uint64(bits - bits // 2))
    one = np.uint64(1)
    rounds = list(enumerate(_round_keys(seed)))
    for number, key in reversed(rounds) if back else rounds:
        low = widths[number % 2]  # the half that is changed; the other half keys it
        mask = (one << low) - one
        high = widths[1 - number % 2]
        if back:
            kept, changed = values & ((one << high) - one), values >> high
            values = (kept << low) | (changed ^ (_mix(kept, key) & mask))
        else:
            kept, changed = values >> low, values & mask
            values = ((changed ^ (_mix(kept, key) & mask)) << high) | kept
    return values


def _walk(values: np.ndarray, n_rows: int, seed: int, back: bool) -> np.ndarray:
    values = _network(np.asarray(values, np.uint64), n_rows, seed, back)
    while (outside := values >= np.uint64(n_rows)).any():
        values[outside] = _network(values[outside], n_rows, seed, back)
    return values.astype(np.int64)


def position(rows: np.ndarray, n_rows: int, seed: int = SEED) -> np.ndarray:
    """Where each row number goes."""
    return _walk(rows, n_rows, seed, back=False)


def row_at(shard: np.ndarray, slot: np.ndarray, n_rows: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number found in a slot of a shard."""
    return _walk(np.asarray(slot) * shards + np.asarray(shard), n_rows, seed, back=True)


def numbered(rows: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``rows`` with ``row``, their place in the order of ``keys``, and how many there are."""
    sorted_ = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    counts = {r.part: r.n for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for number in sorted(counts):
        starts.append((number, total))
        total += counts[number]
    # One row a range, as many as the shuffle has partitions.
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    return sorted_.withColumn("__part", part).join(F.broadcast(offsets), "__part") \
        .withColumn("row", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)) \
        .drop("__part", "__start", "__at"), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and
    the global ``row`` of every row. Only ids, sizes and checksums are shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, total = numbered(rows, RANGES_SORTED_BY)

    @F.pandas_udf("long")
    def moved(row: pd.Series) -> pd.Series:
        return pd.Series(position(row.to_numpy(), total, seed))

    at: Column = F.col("position")
    return placed.withColumn("position", moved("row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (at % shards).cast("int").alias("shard"),
        F.floor(at / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")
