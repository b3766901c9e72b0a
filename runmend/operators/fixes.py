"""Fix suggestions for permanent failures: from a rule table, or from a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmend import fixed
from runmend.functions.prompts import fix_prompt
from runmend.functions.strict_json import parse_fix
from runmend.operators.classify import Model, attach_by_text, call_model, distinct_texts
from runmend.session import shared_dir
from runmend.settings import Settings

# Adds the struct ``fix``: a suggestion for rows with status permanent_no_action, null
# for the others.
Suggester = Callable[[DataFrame], DataFrame]

# Pattern, root cause, steps, prevention; the first pattern found in the text applies.
FIX_RULES = [
    ("not found|does not exist|no such (file|table)",
     "A table, file or path the job reads is missing.",
     ["Check the name and location given in the error", "Restore or create the missing object",
      "Run the job again"],
     "Check that inputs exist before the job starts."),
    ("nameerror|is not defined|syntaxerror",
     "The job code is wrong.",
     ["Open the code at the place the error names", "Define or correct the name", "Test the job, then deploy it"],
     "Run a linter and tests before deploying."),
    ("permission ?denied|does not have .* privilege|unauthorized|access denied|invalid credential",
     "The job's identity lacks a right or a valid credential.",
     ["Find the object and right the error names", "Have the right granted or the credential renewed",
      "Run the job again"],
     "Review the job identity's rights when inputs change."),
    ("cannot resolve|(type|schema) mismatch",
     "The data does not have the columns or types the job expects.",
     ["Compare the schema with the columns the error names", "Adapt the query or the types",
      "Run the job again"],
     "Agree on schemas and check them at the input."),
]
OTHER_FIX = (
    "The error names no known cause.",
    ["Read the full error and its trace", "Correct the cause", "Run the job again"],
    "Make the job report specific errors.",
)


def rule_fix(text: Column) -> Column:
    """Struct of root_cause, fix_steps and prevention for an error text."""

    def fix(cause: str, steps: list[str], prevention: str) -> Column:
        return F.struct(
            F.lit(cause).alias("root_cause"), F.lit(steps).alias("fix_steps"),
            F.lit(prevention).alias("prevention"))

    lowered = F.lower(F.coalesce(text, F.lit("")))
    first, *others = FIX_RULES
    chosen = F.when(lowered.rlike(first[0]), fix(*first[1:]))
    for pattern, *parts in others:
        chosen = chosen.when(lowered.rlike(pattern), fix(*parts))
    return chosen.otherwise(fix(*OTHER_FIX))


def _is_permanent() -> Column:
    return F.col("status") == fixed.PERMANENT_NO_ACTION


def suggest_by_rules() -> Suggester:
    """Fixes from the rule table, as one expression."""
    return lambda rows: rows.withColumn(
        "fix", F.when(_is_permanent(), rule_fix(F.col("error_message"))))


def suggest_by_model(
    model: Model, settings: Settings = Settings(), row_id: str = "run_id",
) -> Suggester:
    """Fixes from one model call per different prompt; the prompt names the job. A call
    that fails gives the fallback. Rows and responses are written to the shared folder,
    so nothing is asked twice."""

    def suggest(rows: DataFrame) -> DataFrame:
        shared_dir(rows.sparkSession)
        rows = rows.withColumn("prompt", F.when(_is_permanent(), fix_prompt(
            F.coalesce("error_message", F.lit("")), F.col("job_id"), F.col("reasoning")))).checkpoint()
        prompts = distinct_texts(rows, "prompt").repartition(settings.model_tasks, "prompt")
        answered = call_model(
            prompts, "prompt", model, settings, answer="raw_fix", keep_going=True).checkpoint()
        told = attach_by_text(rows, answered, settings, row_id, "prompt")
        fix = parse_fix(F.col("raw_fix"), F.col("reasoning"), F.col("call_error"))
        return told.withColumn("fix", F.when(_is_permanent(), fix)).drop(
            "prompt", "raw_fix", "call_error")

    return suggest
