"""Prompts as columns. Error texts are appended, never interpolated, so braces, quotes
and backslashes in them stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runmend import fixed

# The labels differ in what the text itself gives evidence of: one kind, both, or none.
_GUIDE = f"""Below is the error text of one run of a job. Decide what the text itself proves.

1. Look for evidence that the outside world failed for a moment: something was slow, busy, full or out of reach.
2. Look for evidence that the job as written cannot succeed: what it names, needs or may do is wrong.
3. Only the first kind: {fixed.TRANSIENT}. Only the second kind: {fixed.PERMANENT}. Both kinds or neither: {fixed.UNKNOWN}.

Evidence is a statement in the text. A guess at what may lie behind the text is not.

"""
_ANSWER = f"""Reply with JSON alone:
{fixed.CLASSIFICATION_FORM}

Error: """

CLASSIFICATION_PROMPT = (
    _GUIDE
    + "".join(f'Error: "{text}"\nClassification: {label}\n\n' for text, label in fixed.PROMPT_EXAMPLES)
    + _ANSWER
)

FIX_ANSWER = f"""

What should the owner of the job change, in which order, and what keeps it from coming back?
Reply with JSON alone:
{fixed.FIX_FORM}
"""


def classification_prompt(error: Column, template: str = CLASSIFICATION_PROMPT) -> Column:
    return F.concat(F.lit(template), error)


def fix_prompt(error: Column, job_id: Column, reasoning: Column) -> Column:
    return F.concat(
        F.lit("This failure was judged not to go away by itself.\n\nJob "),
        F.coalesce(F.when(job_id != "", job_id), F.lit(fixed.UNKNOWN_JOB)),
        F.lit(" stopped with this error:\n"),
        error,
        F.lit("\n\nWhy it was judged so:\n"),
        F.coalesce(reasoning, F.lit("")),
        F.lit(FIX_ANSWER),
    )
