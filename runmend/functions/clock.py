"""Points in time. Nothing here reads the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant(as_of: datetime, data_type: T.DataType) -> Column:
    """``as_of`` as a literal of the given timestamp type. A value without zone is UTC."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    if isinstance(data_type, T.TimestampNTZType):
        naive = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        return F.expr(f"TIMESTAMP_NTZ '{naive.isoformat(sep=' ')}'")
    return F.lit(as_of)


def instant_like(as_of: datetime, df: DataFrame, column: str, back: timedelta = timedelta()) -> Column:
    """``as_of`` minus ``back``, in the timestamp type of ``df``'s column."""
    return instant(as_of - back, df.schema[column].dataType)


def utc_clock(column: str | Column, data_type: T.DataType) -> Column:
    """What a clock in UTC shows then, to be formatted or cut to a day. A timestamp without
    zone is in UTC already."""
    column = F.col(column) if isinstance(column, str) else column
    return column if isinstance(data_type, T.TimestampNTZType) else F.to_utc_timestamp(column, F.current_timezone())


def whole_millis(column: str | Column) -> Column:
    return F.date_trunc("MILLISECOND", column)


def from_epoch_millis(column: str | Column) -> Column:
    return F.timestamp_millis(column)


def to_epoch_millis(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(column.cast("timestamp"))
