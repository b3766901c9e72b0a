"""Joins whose strategy follows measured sizes, and that spread hot keys."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend.settings import Settings


def _width(field: T.StructField) -> Column:
    """Bytes of a value; eight for all that has a fixed width."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def _size(df: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    width = sum((_width(df.schema[c]) for c in columns or df.columns), F.lit(0))
    return [F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")]


def _fits(row: Row, settings: Settings) -> bool:
    return row["n"] <= settings.broadcast_rows and row["bytes"] <= settings.broadcast_bytes


def is_small(df: DataFrame, settings: Settings, *columns: str) -> bool:
    """True when ``df``, or the columns of it that will be sent, is within the bounds of rows
    and bytes. Only a count and a sum come back."""
    return _fits(df.agg(*_size(df, columns)).first(), settings)


def measure(df: DataFrame, column: str, settings: Settings, *keys: str) -> tuple[bool, datetime | None]:
    """Whether ``keys`` of ``df`` are small, and its earliest ``column``, in one job. The time
    comes back as it is stored, or with its zone, whatever zone this process is in."""
    earliest = F.min(column)
    zoned = isinstance(df.schema[column].dataType, T.TimestampType)
    row = df.agg(
        *_size(df, keys), (F.unix_micros(earliest) if zoned else earliest).alias("earliest")).first()
    small, first = _fits(row, settings), row["earliest"]
    if zoned and first is not None:
        first = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=first)
    return small, first


def keep_keys(big: DataFrame, keys: DataFrame, on: str, small: bool) -> DataFrame:
    """Rows of ``big`` whose ``on`` occurs in ``keys``; with small keys ``big`` is
    filtered where it is read, without a shuffle."""
    keys = keys.select(on)
    return big.join(F.broadcast(keys) if small else keys, on, "left_semi")


def lookup(left: DataFrame, big: DataFrame, key: str, small: bool, row_id: str) -> DataFrame:
    """``left`` with the columns of the row of ``big`` that has the same ``key``.

    ``big`` has at most one row per key. An outer join cannot broadcast the side it
    keeps, so when the keys of ``left`` are small the matching rows of ``big`` are picked
    first, at its scan, by the keys alone. What is left of it may be long texts: it is
    joined without a hint. Null keys match nothing, and ``row_id`` spreads them over the
    partitions.
    """
    if small:
        big = keep_keys(big, left.where(F.col(key).isNotNull()), key, small=True)
    big = big.withColumnRenamed(key, "_key").withColumn("_kind", F.lit(0))
    return (
        left.join(
            big,
            (F.coalesce(F.col(key), F.col(row_id)) == F.col("_key"))
            & (F.when(F.col(key).isNull(), 1).otherwise(0) == F.col("_kind")),
            "left",
        )
        .drop("_key", "_kind")
    )


def join_dimension(
    left: DataFrame, dim: DataFrame, key: str, spread_by: str, small: bool, settings: Settings,
) -> DataFrame:
    """Left join with ``dim``, which has one short row per ``key``.

    Beyond the broadcast bound each key is spread over ``salt_buckets`` pieces, so that
    a key that holds a large part of ``left`` is not joined in one task. The join is asked
    to sort and merge: Spark's estimate of ``dim`` does not grow with its pieces, so it
    would send a table of that many rows through the driver.
    """
    if small:
        return left.join(F.broadcast(dim), key, "left")
    buckets = settings.salt_buckets
    pieces = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("int"))
    return salted.join(pieces.hint("merge"), [key, "_salt"], "left").drop("_salt")
