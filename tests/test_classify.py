"""Labels by rules and by a model function, fixes, prompts and notices."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from runmend import fixed, schemas
from runmend.functions import clock
from runmend.functions.messages import notice_body, numbered_steps
from runmend.functions.prompts import CLASSIFICATION_PROMPT, classification_prompt, fix_prompt
from runmend.operators import classify, fixes, notify
from runmend.settings import Settings


def texts(spark, rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "run_id string, error_message string")


def test_labelled_errors_and_prompt_examples(spark):
    cases = fixed.LABELLED_ERRORS + fixed.PROMPT_EXAMPLES + [(fixed.NOT_FOUND_ERROR, "Permanent")]
    rows = spark.createDataFrame(cases, "error_message string, expected string")
    wrong = classify.classify_by_rules(rows).where("classification <> expected")
    assert wrong.collect() == []


@pytest.mark.parametrize("text,label", [
    ("Connection reset while reading: table not found", "Unknown"),  # evidence of both kinds
    ("CONNECTION REFUSED", "Transient"), ("no evidence at all", "Unknown"), ("", "Unknown"),
    ("x" * 100_000 + " throttled", "Transient")])  # whole texts are searched
def test_rules(spark, text, label):
    (row,) = classify.classify_by_rules(texts(spark, [text])).collect()
    assert (row.classification, row.parse_status) == (label, "OK")


def test_row_without_text_has_no_label(spark):
    (row,) = classify.classify_by_rules(texts(spark, [None])).collect()
    assert row.classification is None and row.parse_status is None


def stub(prompts):
    """Answers by what the text says; prompts end with the text."""
    def answer(prompt):
        text = prompt[len(CLASSIFICATION_PROMPT):]
        if text == "garbled":
            return "I think it is Transient"
        if text == "silent":
            return None
        return '{"classification": "Transient", "reasoning": "said %d", "confidence": "High"}' % len(text)
    return [answer(p) for p in prompts]


ROWS = ["a", "a", "garbled", "silent", None, "a", "{b} 'c'", "garbled"]


@pytest.mark.parametrize("settings", [
    Settings(model_tasks=2, model_batch=1),
    Settings(model_tasks=3, broadcast_rows=0, hot_rows=1),  # texts joined back in pieces
    Settings(model_tasks=1, broadcast_rows=1, hot_rows=10)])
def test_model(spark, settings):
    labelled = classify.model_classifier(stub, settings)(texts(spark, ROWS))
    rows = {int(r.run_id): r for r in labelled.collect()}
    assert sorted(rows) == list(range(len(ROWS)))
    assert [rows[i].parse_status for i in range(len(ROWS))] == [
        "OK", "OK", "PARSE_FAILED", "PARSE_FAILED", None, "OK", "OK", "PARSE_FAILED"]
    assert rows[6].reasoning == "said 7" and rows[4].classification is None
    assert rows[2].raw_response == "I think it is Transient"


def test_model_sees_each_text_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(prompts):
        for i, p in enumerate(prompts):
            (calls / f"{abs(hash(p))}-{i}-{len(list(calls.iterdir()))}").write_text(p)
        return stub(prompts)

    labelled = classify.model_classifier(counting, Settings(model_tasks=2))(texts(spark, ROWS))
    assert labelled.count() == labelled.count() == len(ROWS)
    assert len(list(calls.iterdir())) == 4  # four different texts, asked once


def test_model_with_wrong_number_of_answers_fails(spark):
    with pytest.raises(Exception, match="responses for"):
        classify.model_classifier(lambda prompts: [], Settings(model_tasks=1))(texts(spark, ["a"]))


def test_fixes_by_model(spark):
    def model(prompts):
        if any("Job bad stopped" in p for p in prompts):
            raise RuntimeError("no capacity")
        return ['{"root_cause": "c", "fix_steps": ["x"], "prevention": "p"}' for _ in prompts]

    rows = spark.createDataFrame(
        [("1", "good", "t", "why", "permanent_no_action"), ("2", "bad", "t", "why", "permanent_no_action"),
         ("3", "good", "t", "why", "retry_scheduled"), ("4", "good", None, None, None)],
        "run_id string, job_id string, error_message string, reasoning string, status string")
    found = {r.run_id: r.fix for r in fixes.suggest_by_model(model, Settings(model_tasks=1))(rows).collect()}
    assert found["1"].root_cause == "c"
    # The failing call does not take the others of its batch with it.
    assert (found["2"].root_cause, found["2"].fix_steps) == ("why", [fixed.REVIEW_ERROR_AND_LOGS])
    assert found["3"] is None and found["4"] is None and len(found) == 4


def test_prompts_keep_texts_as_they_are(spark):
    text = "{job_id} 'q' \"d\" \\n {{x}} %s"
    rows = spark.createDataFrame([(text, None, None)], "t string, j string, r string")
    row = rows.select(
        classification_prompt(F.col("t")).alias("c"), classification_prompt(F.col("t"), "own: ").alias("own"),
        fix_prompt(F.col("t"), F.col("j"), F.col("r")).alias("f")).first()
    assert row.c == CLASSIFICATION_PROMPT + text and row.own == "own: " + text
    assert f"error:\n{text}\n" in row.f and "Job unknown stopped" in row.f
    for example, label in fixed.PROMPT_EXAMPLES:
        assert f'Error: "{example}"\nClassification: {label}\n' in row.c


def test_query_parameters_are_not_spliced(spark):
    odd = "it's \\ :x {y}"
    row = spark.sql("SELECT :text AS t", args={"text": odd}).first()
    assert row.t == odd


def test_notice(spark):
    at = datetime(2024, 5, 2, 7, 8, 9)
    rows = spark.createDataFrame([("7", "it's broken\n at line 2", at)], "job_id string, error string, at timestamp")
    fix = F.lit(None).cast(schemas.FIX)
    steps = rows.select(numbered_steps(F.array(F.lit("one"), F.lit("two"))).alias("s")).first().s
    assert steps == "  1. one\n  2. two"
    fix = F.struct(F.lit("cause").alias("root_cause"), F.array(F.lit("one")).alias("fix_steps"), F.lit("N/A").alias("prevention"))
    body = rows.select(notice_body(F.col("job_id"), F.lit("me"), F.col("at"), F.col("error"), fix).alias("b")).first().b
    lines = body.split("\n")
    assert lines[0] == "=" * 60 and lines[5].endswith("Detected: 2024-05-02 07:08:09 UTC")
    assert "it's broken\n at line 2" in body and "Root Cause: cause" in lines and "  1. one" in lines
    assert lines.index("Root Cause: cause") > lines.index("it's broken")


@pytest.mark.parametrize("bound", [0, 10])
def test_owner_falls_back(spark, bound):
    rows = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "c")], "tracking_id string, job_id string")
    jobs = spark.createDataFrame([("a", "ann"), ("b", None)], schemas.JOBS)
    settings = Settings(broadcast_rows=bound, default_owner="desk")
    owners = {r.job_id: r.owner for r in notify.with_owner(rows, jobs, settings).collect()}
    assert owners == {"a": "ann", "b": "desk", "c": "desk"}


def test_instants_and_millis(spark):
    at = datetime(2024, 5, 2, 7, 8, 9, 123456)
    rows = spark.createDataFrame([(at, at)], "z timestamp, n timestamp_ntz")
    aware = at.replace(tzinfo=timezone.utc)
    row = rows.select(
        (F.col("z") == clock.instant_like(at, rows, "z")).alias("z"),
        (F.col("n") == clock.instant_like(aware, rows, "n")).alias("n"),
        clock.to_epoch_millis("n").alias("ms"),
        clock.from_epoch_millis(clock.to_epoch_millis("z")).alias("back")).first()
    assert row.z and row.n
    assert row.ms == int(aware.timestamp() * 1000) and row.back == at.replace(microsecond=123000)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(first_failed_basis="now")
    with pytest.raises(ValueError):
        Settings(notify_on="never")
