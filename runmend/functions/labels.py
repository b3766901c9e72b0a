"""Rule labels: evidence patterns evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend import fixed

LABEL_COLUMNS = ["classification", "reasoning", "confidence", "parse_status", "raw_response"]


def evidence(text: Column) -> Column:
    """Struct of the first transient and the first permanent evidence in the text; empty
    where there is none. Each pattern is searched once."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(
        F.regexp_extract(lowered, f"({fixed.TRANSIENT_PATTERN})", 1).alias("transient"),
        F.regexp_extract(lowered, f"({fixed.PERMANENT_PATTERN})", 1).alias("permanent"))


def label_of(found: Column) -> Column:
    """Struct of classification, reasoning, confidence, parse_status and raw_response.

    Evidence of one kind decides; evidence of both kinds or of none is Unknown.
    """
    transient, permanent = found["transient"], found["permanent"]
    only_transient = (transient != "") & (permanent == "")
    only_permanent = (permanent != "") & (transient == "")
    return F.struct(
        F.when(only_transient, fixed.TRANSIENT)
        .when(only_permanent, fixed.PERMANENT)
        .otherwise(fixed.UNKNOWN).alias("classification"),
        F.when(only_transient, F.concat(F.lit("transient evidence: "), transient))
        .when(only_permanent, F.concat(F.lit("permanent evidence: "), permanent))
        .when(transient != "", F.lit("evidence of both kinds"))
        .otherwise(F.lit("no specific evidence")).alias("reasoning"),
        F.when(only_transient | only_permanent, fixed.HIGH).otherwise(fixed.LOW).alias("confidence"),
        F.lit(fixed.PARSED).alias("parse_status"),
        F.lit(None).cast("string").alias("raw_response"),
    )


def with_rule_label(rows: DataFrame, text: str, only_classification: bool = False) -> DataFrame:
    """Adds the label columns. The evidence has a projection of its own, so that the
    columns share it. A row without text gets nulls, or the label Unknown when only the
    classification is asked for."""
    found = rows.withColumn("_found", evidence(F.col(text)))
    label = label_of(F.col("_found"))
    if only_classification:
        return found.withColumn("classification", label["classification"]).drop("_found")
    label = F.when(F.col(text).isNotNull(), label)
    return found.withColumn("_label", label).select(
        *rows.columns, *[f"_label.{c}" for c in LABEL_COLUMNS])


def status_for(label: Column) -> Column:
    """The status a label leads to; anything but the two decided labels is flagged."""
    return (
        F.when(label == fixed.TRANSIENT, fixed.RETRY_SCHEDULED)
        .when(label == fixed.PERMANENT, fixed.PERMANENT_NO_ACTION)
        .otherwise(fixed.UNKNOWN_FLAGGED)
    )
