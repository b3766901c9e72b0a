"""Strict parsing of model responses, against Python's json."""

import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from runmend import fixed
from runmend.functions.strict_json import fix_json, is_json_object, parse_fix, parse_response

INPUTS = [
    '{"classification":"Transient"}', '```json\n{"a":1}\n```', '{"a":1} extra', "{'a':'T'}",
    '{}', '[]', '[{"a":1}]', '"T"', '3', 'null', '', '{"a":1,"a":2}', '{"a":NaN}',
    ' {"a":"T"} ', '{"a":"T",}', '{"a":"Tr', '{"a":1}{"b":2}', '// c\n{"a":1}', '{"a":"x\ny"}',
    '{"a":1},"x":2', '{"a":1},2', '{"a":1}] x', '{a:1}', '{"a":01}', '{"a":"\\q"}',
    '{"a":{"b":"c"}}', '{"a":[1,{"b":2}]}', '{"a":"\\u00e9"}', '﻿{"a":1}',
    '{"a":"__eoj__"}', '{"a":true}', '{"a":+1}', '{"a":.5}', ' {"a":1}', None,
]


# Strings that look like objects once their quotes are gone.
INPUTS += ['"{"', '"{\\"a\\":1}"', ' \n{"a":1}\t']


def loads_to_object(raw):
    try:
        return isinstance(json.loads(raw), dict)
    except (ValueError, TypeError):
        return False


def accepted(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    found = rows.select("i", is_json_object(F.col("raw")).alias("ok")).collect()
    return [r.ok for r in sorted(found)]


def test_hand_made_inputs(spark):
    assert accepted(spark, INPUTS) == [loads_to_object(raw) for raw in INPUTS]


values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=6)
documents = values.map(json.dumps) | values.map(lambda v: json.dumps(v, ensure_ascii=False, indent=1))


@st.composite
def damaged(draw):
    text = draw(documents)
    at = draw(st.integers(0, len(text)))
    return text[:at] + draw(st.sampled_from(["", " ", ",", "}", "{", "]", '"', "'", "x", "\n", "0"])) + text[
        at + draw(st.integers(0, 1)):]


@settings(max_examples=10, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(documents | damaged(), min_size=100, max_size=100))
def test_like_json_loads(spark, raws):
    wrong = [r for r, ok in zip(raws, accepted(spark, raws)) if ok != loads_to_object(r)]
    assert wrong == []


def parsed(spark, raw):
    rows = spark.createDataFrame([(raw,)], "raw string")
    return rows.select(parse_response(F.col("raw")).alias("p")).first().p


@pytest.mark.parametrize("raw,expected", [
    ('{"classification":"Transient","reasoning":"r","confidence":"Low"}', ("Transient", "r", "Low", "OK")),
    ('{"classification":"Unknown"}', ("Unknown", "", None, "OK")),
    ('{"classification":"transient","reasoning":"r"}', ("Unknown", "r", None, "INVALID_LABEL")),
    ('{"reasoning":"r","more":[1]}', ("Unknown", "r", None, "INVALID_LABEL")),
    ('{"classification":null}', ("Unknown", "", None, "INVALID_LABEL")),
    ('{"classification":"Permanent","classification":"Transient"}', ("Transient", "", None, "OK")),
    ('"Transient"', ("Unknown", fixed.UNPARSED_REASONING, "Low", "PARSE_FAILED")),
    (None, ("Unknown", fixed.UNPARSED_REASONING, "Low", "PARSE_FAILED")),
])
def test_responses(spark, raw, expected):
    p = parsed(spark, raw)
    assert (p.classification, p.reasoning, p.confidence, p.parse_status) == expected
    assert p.raw_response == raw


@pytest.mark.parametrize("raw,reasoning,error,expected", [
    ('{"root_cause":"c","fix_steps":["a","b"],"prevention":"p"}', "r", None, ("c", ["a", "b"], "p")),
    ('{}', "r", None, (fixed.NO_ROOT_CAUSE, [fixed.REVIEW_ERROR], "N/A")),
    ('{"root_cause":null,"fix_steps":null}', "r", None, (fixed.NO_ROOT_CAUSE, [fixed.REVIEW_ERROR], "N/A")),
    ('nothing', "r", None, (fixed.FIX_FAILED, ["r"], "N/A")),
    ('nothing', "", None, (fixed.FIX_FAILED, [fixed.REVIEW_ERROR], "N/A")),
    (None, None, None, (fixed.FIX_FAILED, [fixed.REVIEW_ERROR], "N/A")),
    (None, "r", "timed out", ("r", [fixed.REVIEW_ERROR_AND_LOGS], "N/A")),
])
def test_fixes(spark, raw, reasoning, error, expected):
    rows = spark.createDataFrame([(raw, reasoning, error)], "raw string, reasoning string, error string")
    fix = parse_fix(F.col("raw"), F.col("reasoning"), F.col("error"))
    f, text = rows.select(fix.alias("f"), fix_json(fix).alias("j")).first()
    assert (f.root_cause, f.fix_steps, f.prevention) == expected
    assert json.loads(text) == {"root_cause": expected[0], "fix_steps": expected[1], "prevention": expected[2]}
