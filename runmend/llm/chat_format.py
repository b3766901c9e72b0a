"""Chat formatting: layouts known by the fingerprint of their field paths, one template.

1. A record's fingerprint is the hash of its nested field paths (``messages[].role``), in
   order, of those paths that any layout knows. A typed table has one, from its schema; a
   JSON record has its own, taken in the JVM from its variant. The fingerprint picks a
   ``Layout``, which says where turns, roles and texts are: prompts with completions,
   instructions, message lists, rows that are turns. All become the same turns.
2. The template writes a turn as ``[INST] text [/INST]`` (user), ``<s>text</s>`` (assistant)
   or ``[ROLE] role [TEXT] text [/ROLE]``. Control strings inside of roles and texts, of this
   template and of others, get a backslash behind their first character, and one more where
   some are there. No control string holds another's first character, so taking one away
   gives the text back.
3. A conversation's turns are put together in segments of about ``SEGMENT`` characters, whole
   turns each, with the spans of assistant texts as loss mask. Rows are sorted by Spark and
   stream through a task, so memory is bounded by a segment, also for a conversation that
   holds a third of all rows. (Its digest is one sequence of hashing, so it is one task.)

Defined cases: null roles and texts are empty; turns go by number, null first, equal numbers by
role, then text; null ids are one conversation; a record of an unknown layout, or that is no
JSON object, gives one row whose ``layout`` is null; an empty table gives no conversation;
columns that no layout knows are ignored, and a table that mixes two layouts' columns is
refused, so select the columns that count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER, ASSISTANT, SYSTEM = "user", "assistant", "system"
SEGMENT = 1 << 20

#: What roles are called in layouts that have their own names.
ROLE_NAMES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


@dataclass(frozen=True)
class Said:
    """One turn: a fixed role, and the fields whose texts, those that are there, make it up."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list of messages. ``parts`` is a list within the message
    whose elements hold the text."""

    items: str
    role: str
    text: str
    parts: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        text = f"{self.parts}[].{self.text}" if self.parts else self.text
        return f"{self.items}[].{self.role}", f"{self.items}[].{text}"


@dataclass(frozen=True)
class Layout:
    """Where a layout has its turns, in order. Paths in ``may`` need not be there."""

    name: str
    turns: tuple[Said | Each, ...]
    may: tuple[str, ...] = ()

    def path_sets(self) -> Iterator[tuple[str, ...]]:
        """Every set of paths that records of this layout can have."""
        every = [p for part in self.turns for p in part.paths]
        for n in range(len(self.may) + 1):
            for left_out in combinations(self.may, n):
                yield tuple(sorted(set(every) - set(left_out)))


#: A row that is a turn of a conversation.
TURN_ROWS = Layout("turn rows", (Said("", ("role", "text", "turn")),))

LAYOUTS = (
    Layout("prompt and completion", (Said(SYSTEM, ("system",)), Said(USER, ("prompt",)), Said(ASSISTANT, ("completion",))), ("system",)),
    Layout("prompt and response", (Said(SYSTEM, ("system",)), Said(USER, ("prompt",)), Said(ASSISTANT, ("response",))), ("system",)),
    Layout("question and answer", (Said(USER, ("context", "question")), Said(ASSISTANT, ("answer",))), ("context",)),
    Layout("instruction", (Said(SYSTEM, ("system",)), Said(USER, ("instruction", "input")), Said(ASSISTANT, ("output",))), ("system", "input")),
    Layout("messages", (Said(SYSTEM, ("system",)), Each("messages", "role", "content")), ("system",)),
    Layout("message parts", (Said(SYSTEM, ("system",)), Each("messages", "role", "text", parts="content")), ("system",)),
    Layout("from and value", (Said(SYSTEM, ("system",)), Each("conversations", "from", "value")), ("system",)),
)


def fingerprint_of(paths: Iterator[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint_of(paths): layout for layout in (TURN_ROWS, *LAYOUTS) for paths in layout.path_sets()}
PATHS = sorted({p for layout in LAYOUTS for part in layout.turns for p in part.paths})


# --- 1. layouts to turns ---------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(schema: T.StructType) -> Layout:
    """The layout of a typed table."""
    known = set(PATHS) | set(TURN_ROWS.turns[0].paths)
    paths = [p for p in field_paths(schema) if p in known]
    layout = BY_FINGERPRINT.get(fingerprint_of(paths))
    if layout is None:
        raise ValueError(f"no layout has the fields {paths}")
    return layout


def _variant(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _present(record: Column, path: str) -> Column:
    """Whether the record has the path; in a list, whether any element has it."""
    first, *rest = path.split("[].")
    if not rest:
        # A scalar or null at this place; a list or an object there is another path.
        return F.coalesce(~F.schema_of_variant(_variant(record, path, "variant")).rlike("^(ARRAY|OBJECT)"), F.lit(False))
    items = _variant(record, first, "array<variant>")
    return F.coalesce(F.exists(items, lambda item: _present(item, "[].".join(rest))), F.lit(False))


def with_layout(records: DataFrame, record: str) -> DataFrame:
    """Adds ``_record`` (the JSON text of column ``record`` as a variant), ``fingerprint`` and
    ``layout``, null where no layout has that fingerprint."""
    there = records.withColumn("_record", F.try_parse_json(F.col(f"`{record}`")))
    paths = F.concat_ws("\n", *[F.when(_present(F.col("_record"), p), F.lit(p)) for p in PATHS])
    names = F.coalesce(*[F.when(F.col("fingerprint") == key, layout.name)
                         for key, layout in BY_FINGERPRINT.items() if layout is not TURN_ROWS])
    return there.withColumn("fingerprint", F.sha2(paths, 256)).withColumn("layout", names)


def _role(name: Column) -> Column:
    named = F.coalesce(*[F.when(name == old, new) for old, new in ROLE_NAMES.items()])
    return F.coalesce(named, name)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(record: Column, part: Said | Each) -> Column:
    """The turns of a part of the record as a list; empty where it is left out."""
    kind = "array<struct<role:string,text:string>>"
    if isinstance(part, Said):
        text = F.concat_ws("\n", *[_variant(record, p, "string") for p in part.paths])
        some = _present(record, part.paths[0])
        for path in part.paths[1:]:
            some = some | _present(record, path)
        return F.when(some, F.array(_turn(F.lit(part.role), text))).otherwise(F.array()).cast(kind)

    def one(item: Column) -> Column:
        if part.parts is None:
            return _turn(_role(_variant(item, part.role, "string")), _variant(item, part.text, "string"))
        parts = F.transform(_variant(item, part.parts, "array<variant>"), lambda p: _variant(p, part.text, "string"))
        return _turn(_role(_variant(item, part.role, "string")), F.array_join(parts, "\n"))

    return F.coalesce(F.transform(_variant(record, part.items, "array<variant>"), one), F.array()).cast(kind)


def record_turns(records: DataFrame, id_col: str, record: str) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``layout`` of JSON records of mixed layouts."""
    known = with_layout(records, record)
    turns = F.coalesce(*[
        F.when(F.col("layout") == layout.name, F.concat(*[_turns(F.col("_record"), part) for part in layout.turns]))
        for layout in LAYOUTS])
    return known.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), "layout", F.posexplode_outer(turns).alias("turn", "t")) \
        .select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def table_turns(table: DataFrame, id_col: str) -> DataFrame:
    """The same of a typed table, whose schema tells its layout."""
    layout = layout_of(table.schema)
    conv_id = F.col(f"`{id_col}`").cast("long").alias("conv_id")
    if layout is TURN_ROWS:
        return table.select(conv_id, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                            F.col("text").cast("string").alias("text"), F.lit(layout.name).alias("layout"))
    known = [c for c in table.columns if any(p == c or p.startswith((f"{c}.", f"{c}[]")) for p in PATHS)]
    return record_turns(table.select(conv_id, F.to_json(F.struct(*known)).alias("record")), "conv_id", "record")


# --- 2. the template -------------------------------------------------------------

# Control strings without their first character, < or [.
_CONTROL = r"/?(?:s>|INST\]|ROLE\]|TEXT\]|SYS>|start_of_turn>|end_of_turn>)|\|[a-z0-9_]+\|>"
ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"
_UNESCAPE = re.compile(UNESCAPE)
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE\] (.*?) \[TEXT\] (.*?) \[/ROLE\]", re.S)
_MASK_FROM = len("<s>")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``piece``, the turn in the template, and ``masked``, the number of its characters
    that count for the loss; they start behind ``<s>``. A row alone decides; nothing moves."""
    text, role = escaped(F.col("text")), F.coalesce("role", F.lit(""))
    piece = (
        F.when(role == USER, F.concat(F.lit("[INST] "), "_text", F.lit(" [/INST]")))
        .when(role == ASSISTANT, F.concat(F.lit("<s>"), "_text", F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [TEXT] "), "_text", F.lit(" [/ROLE]"))))
    return turns.withColumn("_text", text).withColumn("piece", piece) \
        .withColumn("masked", F.when(role == ASSISTANT, F.length("_text"))).drop("_text")


# --- 3. conversations --------------------------------------------------------------

_SEGMENTS = "conv_id long, segment long, formatted string, loss array<struct<start:int,end:int>>"


def assemble(formatted: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """``conv_id``, ``segment``, ``formatted``, ``loss``: conversations as text, with the spans
    of characters that count for the loss. The segments of a conversation follow each other
    in one partition; only a conversation beyond ``limit`` characters has several."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, number, pieces, loss, size = None, 0, [], [], 0
        for batch in batches:
            for conv_id, piece, masked in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "masked"))):
                if pieces and (conv_id != now or size + len(piece) > limit):
                    yield now, number, "".join(pieces), loss
                    number = number + 1 if conv_id == now else 0
                    pieces, loss, size = [], [], 0
                now = conv_id
                if masked is not None:
                    loss.append((size + _MASK_FROM, size + _MASK_FROM + masked))
                pieces.append(piece)
                size += len(piece)
        if pieces:
            yield now, number, "".join(pieces), loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in segments(batches):
            held.append((*row[:3], [{"start": a, "end": b} for a, b in row[3]]))
            size += len(row[2])
            if size > limit:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    # Null is smaller than any turn; ties go by role and text.
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "masked").mapInArrow(run, _SEGMENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts that a formatted text was made of."""
    for match in _TURN.finditer(formatted):
        user, assistant, role, text = match.groups()
        if user is not None:
            yield USER, unescaped(user)
        elif assistant is not None:
            yield ASSISTANT, unescaped(assistant)
        else:
            yield unescaped(role), unescaped(text)


def read_back(assembled: DataFrame) -> DataFrame:
    """What conversations hold, from their formatted text and loss spans alone: ``conv_id``,
    ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``. Takes the
    rows of :func:`assemble` as they come, segment by segment."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state = None
        for batch in batches:
            for conv_id, segment, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if segment == 0:
                    if state is not None:
                        yield state
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescaped(formatted[span["start"]:span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
        if state is not None:
            yield state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for state in digests(batches):
            held.append(tuple(v.hexdigest() if hasattr(v, "hexdigest") else v for v in state))
            if len(held) >= 4096:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return assembled.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are made of control strings, as a record with messages.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of all ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``) and of the
    probe, as conversation -1."""
    probe = conversations.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PROBE).alias("record"))
    turns = table_turns(conversations.select("conv_id", "turn", "role", "text"), "conv_id") \
        .unionByName(record_turns(probe, "conv_id", "record"))
    return read_back(assemble(format_turns(turns)))


def oracle_sql() -> str:
    count = "len(regexp_extract_all({}, '" + ESCAPE + "'))"
    text, role = count.format("text"), count.format("role")
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(text) + {text} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 23 + length(role) + {role} END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""
