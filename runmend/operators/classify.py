"""Labels for error texts: by rules in the JVM, or by a caller's model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend.functions.labels import LABEL_COLUMNS, status_for, with_rule_label
from runmend.functions.prompts import CLASSIFICATION_PROMPT, classification_prompt
from runmend.functions.strict_json import parse_response
from runmend.operators import joins
from runmend.session import shared_dir
from runmend.settings import Settings

# A model: prompts in, one raw response per prompt out.
Model = Callable[[list[str]], list[str | None]]
# A classifier: adds the label columns; they are null for a row without error_message.
Classifier = Callable[[DataFrame], DataFrame]


def classify_by_rules(rows: DataFrame) -> DataFrame:
    """Adds the label columns; no shuffle and no Python."""
    return with_rule_label(rows, "error_message")


def decide(rows: DataFrame) -> DataFrame:
    """Adds the status the label leads to; a status that is set already stays."""
    status = status_for(F.col("classification"))
    if "status" in rows.columns:
        status = F.coalesce("status", status)
    return rows.withColumn("status", status)


def call_model(
    prompts: DataFrame, prompt: str, model: Model, settings: Settings,
    answer: str = "raw_response", keep_going: bool = False,
) -> DataFrame:
    """Adds the raw answers, under the name given, and call_error. With ``keep_going`` a failing
    call is recorded for the prompt it fails on, otherwise it fails the task. A call that
    fails is repeated in halves, so the other half's texts are asked together, once more."""
    size = settings.model_batch

    def ask(texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        answers = list(model(texts))
        if len(answers) != len(texts):
            raise ValueError(f"model gave {len(answers)} responses for {len(texts)} prompts")
        return answers, [None] * len(texts)

    def ask_in_halves(texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            return ask(texts)
        except Exception as error:
            if len(texts) == 1:
                return [None], [str(error) or type(error).__name__]
        half = len(texts) // 2
        (first, failed), (second, failed_too) = ask_in_halves(texts[:half]), ask_in_halves(texts[half:])
        return first + second, failed + failed_too

    call = ask_in_halves if keep_going else ask

    def respond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start:start + size]
                answers, errors = call(part[prompt].tolist())
                yield part.assign(**{answer: answers, "call_error": errors})

    schema = T.StructType([
        *prompts.schema, T.StructField(answer, T.StringType()), T.StructField("call_error", T.StringType())])
    return prompts.mapInPandas(respond, schema)


def distinct_texts(rows: DataFrame, text: str = "error_message") -> DataFrame:
    """Each text once, with how often it occurs."""
    return rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))


def attach_by_text(
    rows: DataFrame, found: DataFrame, settings: Settings, row_id: str, text: str = "error_message",
) -> DataFrame:
    """What was found per text, joined back to the rows. ``found`` has one row per text
    with its count ``n``. A text that occurs more than ``hot_rows`` times is spread over
    pieces by ``row_id``; there are at most rows / hot_rows such texts. Rows without a
    text are not joined and get nulls."""
    added = [c for c in found.columns if c not in (text, "n")]
    nothing = rows.where(F.col(text).isNull())
    rows = rows.where(F.col(text).isNotNull()).withColumn("_key", F.xxhash64(text))
    found = found.withColumn("_key", F.xxhash64(text))
    on = ["_key", text]
    hot_text = F.col("n") > settings.hot_rows
    if joins.is_small(found, settings):
        found = F.broadcast(found)
    else:
        count = F.ceil(F.max("n") / settings.hot_rows).cast("int")
        hot = found.where(hot_text).groupBy("_key").agg(count.alias("_pieces"))
        if joins.is_small(hot, settings):
            hot = F.broadcast(hot)
        pieces = F.coalesce("_pieces", F.lit(1))
        rows = rows.join(hot, "_key", "left").withColumn(
            "_piece", F.pmod(F.xxhash64(row_id), pieces).cast("int")).drop("_pieces")
        found = found.join(hot, "_key", "left").withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
        on = ["_key", "_piece", text]
    joined = rows.join(found.drop("n"), on, "left").drop("_key", "_piece")
    columns = [c for c in nothing.columns] + added
    return joined.select(columns).unionByName(nothing, allowMissingColumns=True)


def model_classifier(
    model: Model, settings: Settings = Settings(), template: str = CLASSIFICATION_PROMPT,
    row_id: str = "run_id",
) -> Classifier:
    """A classifier that calls ``model`` once per distinct text.

    Rows and responses are written to the shared folder: a lost executor must not make
    the model answer again, perhaps differently, and rows read twice must be the same.
    """

    def classify(rows: DataFrame) -> DataFrame:
        shared_dir(rows.sparkSession)
        rows = rows.checkpoint()
        texts = distinct_texts(rows).repartition(settings.model_tasks, "error_message")
        asked = texts.withColumn("prompt", classification_prompt(F.col("error_message"), template))
        answered = call_model(asked, "prompt", model, settings).checkpoint()
        labels = (
            answered.withColumn("_label", parse_response(F.col("raw_response")))
            .select("error_message", "n", *[f"_label.{c}" for c in LABEL_COLUMNS])
        )
        return attach_by_text(rows, labels, settings, row_id)

    return classify


def classify_dedup(rows: DataFrame, settings: Settings) -> DataFrame:
    """Labels computed once per distinct text and joined back. The rows are read once, and
    so are the labels: their number is taken from what was made."""
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint()
    labels = classify_by_rules(distinct_texts(rows)).checkpoint()
    return attach_by_text(rows, labels, settings, "run_id")
