"""Model responses as columns, accepting exactly what a strict JSON parser accepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runmend import fixed, schemas

_END = "__eoj__"
_OPTIONS = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}


def is_json_object(raw: Column) -> Column:
    """True when ``raw`` is one JSON object and nothing else.

    ``from_json`` alone stops at the end of the first value, so the text is put in an
    array before an end mark: only a single complete value leaves two elements. That it
    is an object shows in the text itself, as a string element loses its quotes.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), raw, F.lit(f',"{_END}"]')), "array<string>", _OPTIONS)
    one_object = (
        (F.size(wrapped) == 2)
        & (F.get(wrapped, F.lit(1)) == _END)
        & raw.rlike(r"^[ \t\n\r]*\{")
    )
    return F.coalesce(one_object, F.lit(False))


def parse_response(raw: Column) -> Column:
    """Struct of classification, reasoning, confidence, parse_status and raw_response."""
    parsed = F.from_json(
        F.when(is_json_object(raw), raw),
        "classification string, reasoning string, confidence string", _OPTIONS)
    # An object parses to a struct, if need be one of nulls.
    failed = parsed.isNull()
    label = parsed["classification"]
    valid = F.coalesce(label.isin(fixed.LABELS), F.lit(False))
    return F.struct(
        F.when(valid, label).otherwise(fixed.UNKNOWN).alias("classification"),
        F.when(failed, fixed.UNPARSED_REASONING)
        .otherwise(F.coalesce(parsed["reasoning"], F.lit(""))).alias("reasoning"),
        F.when(failed, fixed.LOW).otherwise(parsed["confidence"]).alias("confidence"),
        F.when(failed, fixed.PARSE_FAILED).when(valid, fixed.PARSED)
        .otherwise(fixed.INVALID_LABEL).alias("parse_status"),
        raw.alias("raw_response"),
    )


def parse_fix(raw: Column, reasoning: Column, call_error: Column | None = None) -> Column:
    """Struct of root_cause, fix_steps and prevention with the defaults filled in."""
    parsed = F.from_json(F.when(is_json_object(raw), raw), schemas.FIX, _OPTIONS)
    said = F.when(reasoning != "", reasoning)
    complete = F.struct(
        F.coalesce(parsed["root_cause"], F.lit(fixed.NO_ROOT_CAUSE)).alias("root_cause"),
        F.coalesce(parsed["fix_steps"], F.array(F.lit(fixed.REVIEW_ERROR))).alias("fix_steps"),
        F.coalesce(parsed["prevention"], F.lit(fixed.NOT_AVAILABLE)).alias("prevention"),
    )
    unreadable = F.struct(
        F.lit(fixed.FIX_FAILED).alias("root_cause"),
        F.array(F.coalesce(said, F.lit(fixed.REVIEW_ERROR))).alias("fix_steps"),
        F.lit(fixed.NOT_AVAILABLE).alias("prevention"),
    )
    not_called = F.struct(
        reasoning.alias("root_cause"),
        F.array(F.lit(fixed.REVIEW_ERROR_AND_LOGS)).alias("fix_steps"),
        F.lit(fixed.NOT_AVAILABLE).alias("prevention"),
    )
    answered = F.when(parsed.isNotNull(), complete).otherwise(unreadable)
    return answered if call_error is None else F.when(
        call_error.isNotNull(), not_called).otherwise(answered)


def fix_json(fix: Column) -> Column:
    return F.to_json(fix, {"ignoreNullFields": "false"})
