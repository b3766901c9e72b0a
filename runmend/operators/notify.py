"""Notices to job owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend.functions.clock import utc_clock
from runmend.functions.messages import notice_body
from runmend.functions.strict_json import fix_json
from runmend.operators import joins
from runmend.settings import Settings


def with_owner(
    rows: DataFrame, jobs: DataFrame, settings: Settings = Settings(), spread_by: str = "tracking_id",
) -> DataFrame:
    """Rows with ``owner``: the creator of the job, or the default owner."""
    creators = jobs.select("job_id", F.col("creator_user_name").alias("owner"))
    small = joins.is_small(creators, settings)
    found = joins.join_dimension(rows, creators, "job_id", spread_by, small, settings)
    return found.withColumn("owner", F.coalesce("owner", F.lit(settings.default_owner)))


def notifications(rows: DataFrame, notified_at: Column) -> DataFrame:
    """Notification rows. ``rows`` has job_id, owner, error_message, reasoning and fix."""
    return rows.select(
        "job_id",
        F.col("owner").alias("notified_user"),
        "error_message",
        F.col("reasoning").alias("ai_reasoning"),
        fix_json(F.col("fix")).alias("fix_suggestion"),
        notified_at.alias("notification_time"),
    )


def notice_bodies(rows: DataFrame, detected_at: Column) -> DataFrame:
    """Adds ``body``, the text of the notice."""
    detected_at = utc_clock(detected_at, rows.select(detected_at).schema[0].dataType)
    return rows.withColumn("body", notice_body(
        F.col("job_id"), F.col("owner"), detected_at, F.col("error_message"), F.col("fix")))
