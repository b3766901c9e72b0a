"""Reading the input tables, whole or as streams, with their declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from runmend.session import scratch_path


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, file_format: str = "parquet", **options: str,
) -> DataFrame:
    """A table of files. Nothing is inferred, so no file is opened before the query."""
    return spark.read.format(file_format).schema(schema).options(**options).load(path)


def read_table_if_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, empty while nothing has been written."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared folder, for rows that a plan reads several
    times: they are derived once, and their size is known to the optimizer."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType | str, file_format: str = "parquet", **options: str,
) -> DataFrame:
    """New files of a table as they arrive; the stream's checkpoint remembers which
    files were read."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)
