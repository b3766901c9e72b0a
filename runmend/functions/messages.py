"""Notification text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runmend import fixed


def notice_time(ts: Column) -> Column:
    """``ts`` as text; it has to be a UTC clock's, as :func:`runmend.functions.clock.utc_clock` gives it."""
    return F.date_format(ts, fixed.NOTICE_TIME_FORMAT)


def numbered_steps(steps: Column) -> Column:
    """Steps numbered from 1, one per line."""
    lines = F.transform(steps, lambda step, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), step))
    return F.array_join(lines, "\n")


def notice_body(job_id: Column, owner: Column, detected: Column, error: Column, fix: Column) -> Column:
    """The two sections of a notice: the error as it was, then the suggested fix."""
    return F.concat_ws(
        "\n",
        F.lit(fixed.RULE_LINE),
        F.lit(fixed.NOTICE_TITLE),
        F.lit(fixed.RULE_LINE),
        F.concat(F.lit(fixed.NOTICE_JOB), job_id),
        F.concat(F.lit(fixed.NOTICE_OWNER), owner),
        F.concat(F.lit(fixed.NOTICE_TIME), notice_time(detected)),
        F.lit(""),
        F.lit(fixed.NOTICE_ERROR),
        error,
        F.lit(""),
        F.lit(fixed.RULE_LINE),
        F.lit(fixed.NOTICE_FIX_TITLE),
        F.lit(fixed.RULE_LINE),
        F.concat(F.lit(fixed.NOTICE_ROOT_CAUSE), fix["root_cause"]),
        F.lit(""),
        F.lit(fixed.NOTICE_STEPS),
        numbered_steps(fix["fix_steps"]),
        F.lit(""),
        F.concat(F.lit(fixed.NOTICE_PREVENTION), fix["prevention"]),
        F.lit(""),
        F.lit(fixed.RULE_LINE),
        F.lit(fixed.NOTICE_FOOTER),
        F.lit(fixed.RULE_LINE),
    )
