"""A Merkle manifest of a corpus: proofs, and folding from retained hash states.

Every row is a leaf, every source a tree of its rows in order of their id, and the trees'
roots are the leaves of one tree more. A parent is the hash of ``FAN_OUT`` children at most.

Rows get their place in their tree from a range partitioning and one count per partition
and source, so a source with a third of all rows is spread like any other. Then trees are
worked on by blocks of ``FAN_OUT ** LEVELS`` neighbours, whole subtrees of ``LEVELS`` levels:

* up: a block becomes its top node, and the top nodes are the rows of the next pass, 4,096
  times fewer, until each tree has one node;
* down: a block hands every child its siblings on the way to the root, as the text left of
  it and right of it on each level. One such row per block meets the rows of the block by
  being sorted ahead of them.

While a parent's hash is made, a copy of its state is kept before each child slot. Folding
takes the copy of the slot, feeds it the replacement and the siblings right of it: what is
left of the slot is never hashed again, however many rows below are checked. Levels above
the block keep one state each, for the slot that the block is in.

Whether a block is its whole tree follows from the block alone: it is the first and has
fewer rows than fit. So no task needs a source's size.

Defined cases: nulls hash as ``-``; a null source is a tree of its own, the first; null ids
come first in their tree and are never tampered with; rows with the same id follow their
leaf hashes, so the manifest does not depend on the order of reading; an empty table has no
rows; a lone row's proof is the hash of the empty text; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmend.llm.common import stored

FAN_OUT = 16
LEVELS = 3
BLOCK = FAN_OUT ** LEVELS
#: Up to so many (partition, source) pairs their offsets are broadcast.
BROADCAST_OFFSETS = 100_000
_DIGEST = 64

LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of the values, each with its length, so that no two rows read the same."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as the check finds it: capitals of one id in five are lower-cased."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place in their tree from 0, for trees of any size."""
    placed = stored(
        rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
        .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "placed")
    before = W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = placed.groupBy(tree, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")) \
        .select(F.col(tree).alias("__tree"), F.col("__part").alias("__in"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    runs = stored(runs, "runs")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_OFFSETS else runs
    return placed.join(runs, (F.col("__part") == F.col("__in")) & F.col(tree).eqNullSafe(F.col("__tree"))) \
        .withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")) \
        .drop("__at", "__part", "__in", "__tree", "__first", "__before")


class Subtree:
    """A block's levels, with the state of every parent before each of its slots."""

    def __init__(self, digests: list[bytes], first: bool):
        self.groups: list[list[tuple[bytes, list]]] = []
        whole = first and len(digests) < BLOCK
        while len(digests) > 1 if whole else len(self.groups) < LEVELS:
            level, parents = [], []
            for start in range(0, len(digests), FAN_OUT):
                run = digests[start:start + FAN_OUT]
                state, before = hashlib.sha256(), []
                for child in run:
                    before.append(state.copy())
                    state.update(child)
                level.append((b"".join(run), before))
                parents.append(state.hexdigest().encode())
            self.groups.append(level)
            digests = parents
        self.top = digests[0]

    def steps(self, at: int) -> Iterator[tuple[object, bytes, bytes]]:
        """From child ``at`` upwards: the state before its slot, and its siblings."""
        for level in self.groups:
            at, slot = divmod(at, FAN_OUT)
            run, before = level[at]
            yield before[slot], run[:slot * _DIGEST], run[(slot + 1) * _DIGEST:]


def resume(state: object, replacement: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (tree, block), which stand together; a block is bounded."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if held and row[:2] != key:
                yield key, held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *more)


def rise(nodes: DataFrame) -> DataFrame:
    """``tree``, ``idx``, ``digest`` of the tops of the blocks of ``nodes`` (the same columns)."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((
            (tree, block, Subtree([row[3].encode() for row in rows], block == 0).top.decode())
            for (tree, block), rows in _blocks(batches)), schema)

    blocks = _dealt(nodes.select("tree", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "digest"), "idx")
    return blocks.mapInArrow(run, "tree string, idx long, digest string")


def passes(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tops of each pass over them; the last has one node for each tree."""
    levels = [nodes]
    while len(levels) == 1 or not levels[-1].where("idx > 0").isEmpty():
        levels.append(stored(rise(levels[-1]), "tops"))
    return levels


_PATH = "lefts array<string>, rights array<string>, subroot string, root string"
_ROWS = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("lefts", pa.list_(pa.string())),
                   ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])


def _with_path(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of blocks, each block behind the one row that has the path of its top."""
    block = F.expr(f"idx div {BLOCK}").alias("block")
    below = nodes.select("tree", block, F.col("idx").alias("idx"), *[c for c in nodes.columns if c not in ("tree", "idx")])
    above = paths.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "lefts", "rights", "subroot", "root")
    both = above.unionByName(below, allowMissingColumns=True)
    return _dealt(both.select("tree", "block", "idx", "lefts", "rights", "subroot", "root", *[c for c in nodes.columns if c not in ("tree", "idx")]), "idx")


def descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The path of every node, from those of the blocks' tops."""
    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, _), (top, *rows) in _blocks(batches):
            _, _, _, lefts, rights, subroot, root, _ = top
            block = Subtree([row[7].encode() for row in rows], rows[0][2] == 0)
            for at, row in enumerate(rows):
                steps = [(left.decode(), right.decode()) for _, left, right in block.steps(at)]
                yield tree, row[2], [s[0] for s in steps] + lefts, [s[1] for s in steps] + rights, subroot, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(below(batches), _ROWS, 1024)

    nodes = nodes.select("tree", "idx", "digest")
    return _with_path(nodes, paths).mapInArrow(run, f"tree string, idx long, {_PATH}")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The proof of each leaf and what its replacement folds to."""
    for (tree, _), (top, *rows) in _blocks(batches):
        _, _, _, lefts, rights, subroot, root, _, _, _ = top
        above = [(hashlib.sha256(left.encode()), right.encode()) for left, right in zip(lefts, rights)]
        siblings = "".join(left + right for left, right in zip(lefts, rights)).encode()
        block = Subtree([row[7].encode() for row in rows], rows[0][2] == 0)
        for at, row in enumerate(rows):
            proof, value = hashlib.sha256(), row[8].encode()
            for state, left, right in block.steps(at):
                proof.update(left)
                proof.update(right)
                value = resume(state, value, right)
            proof.update(siblings)
            for state, right in above:
                value = resume(state, value, right)
            folded = value.decode()
            yield row[9], tree, row[7], subroot, root, proof.hexdigest(), folded, folded == root


@dataclass(frozen=True)
class Manifest:
    """The nodes that passes end at: ``trees`` from the leaves on, ``over`` from the trees'
    roots to the one root. ``trees[-1]`` holds the subroots, ``over[-1]`` the root."""

    trees: list[DataFrame]
    over: list[DataFrame]

    def verify(self) -> DataFrame:
        """For every leaf: ``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``,
        ``proof_sha256``, ``folded_root`` (from ``found``, the leaf as it is found now) and
        ``verified``."""
        none = F.array().cast("array<string>")
        paths = self.over[-1].select("tree", "idx", none.alias("lefts"), none.alias("rights"),
                                     F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        for nodes in self.over[-2::-1]:
            paths = descend(nodes, paths)
        numbers = self.over[0].select(F.col("idx"), F.col("source"), F.col("digest").alias("__sub"))
        paths = paths.drop("tree", "subroot").join(numbers, "idx").select(
            F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("__sub").alias("subroot"), "root")
        for nodes in self.trees[-2:0:-1]:
            paths = descend(nodes, paths)
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("source", "leaf", "subroot", "root", "proof_sha256", "folded_root")),
                            ("verified", pa.bool_())])
        leaves = self.trees[0].select("tree", "idx", "digest", "found", "doc_id")
        return _with_path(leaves, paths).mapInArrow(
            lambda batches: _batches(_checked(batches), schema),
            "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def build(docs: DataFrame, found: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``found`` is the text as a later check reads it; by default
    it is the text itself."""
    fields = {c: F.col(f"`{c}`") for c in LEAF_FIELDS}
    now = fields | {"text": fields["text"] if found is None else found}
    leaves = stored(docs.select(
        fields["source"].cast("string").alias("tree"), fields["doc_id"].cast("long").alias("doc_id"),
        leaf(*fields.values()).alias("digest"), leaf(*now.values()).alias("found"),
        # Equal rows are told apart only to spread them.
        F.monotonically_increasing_id().alias("row")), "leaves")
    trees = passes(stored(numbered(leaves, "tree", "doc_id", "digest", "row").drop("row"), "numbered"))
    roots = trees[-1].select(F.lit(0).alias("all"), F.col("tree").alias("source"), "digest")
    one = F.lit(None).cast("string").alias("tree")
    over = passes(stored(numbered(roots, "all", "source").select(one, "idx", "digest", "source"), "subroots"))
    return Manifest(trees, over)


def check_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against texts of which some were tampered with."""
    return build(docs, tampered(F.col("doc_id"), F.col("text"))).verify()


# CRC-32 of a text, a byte or a bit at a time, for DuckDB, which has no such function.
def crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _levels_sql(name: str, tree: str, count: int) -> list[str]:
    """Levels of trees, one table each, from ``{name}0`` (tree, idx, digest, found) on; a tree
    with one node left stays as it is. Then each leaf's siblings and folding on the way."""
    levels = []
    for n in range(1, count + 1):
        below = f"{name}{n - 1}"
        levels.append(f"""{name}{n} AS MATERIALIZED (SELECT {tree}, CASE WHEN m = 1 THEN idx ELSE idx // {FAN_OUT} END AS idx,
  CASE WHEN any_value(m) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS m FROM {below}) GROUP BY {tree}, CASE WHEN m = 1 THEN idx ELSE idx // {FAN_OUT} END, m)""")
    return levels


def _climb_sql(name: str, levels: str, tree: str, count: int) -> list[str]:
    """Walks ``{name}0`` (tree, pos, value, proof, ...) up ``count`` levels."""
    steps = []
    for n in range(count):
        join = f"LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY {tree}) AS m FROM {levels}{n}) s ON s.{tree} IS NOT DISTINCT FROM w.{tree} AND s.idx // {FAN_OUT} = w.pos // {FAN_OUT} AND s.m > 1"
        steps.append(f"""{name}{n + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (pos, value, proof),
  CASE WHEN count(s.idx) = 0 THEN any_value(w.pos) ELSE any_value(w.pos) // {FAN_OUT} END AS pos,
  CASE WHEN count(s.idx) = 0 THEN any_value(w.value) ELSE sha256(string_agg(CASE WHEN s.idx = w.pos THEN w.value ELSE s.digest END, '' ORDER BY s.idx)) END AS value,
  any_value(w.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx <> w.pos), '') AS proof
  FROM {name}{n} w {join} GROUP BY ALL)""".replace("SELECT w.* EXCLUDE (pos, value, proof)", "SELECT w.row, w.doc_id, w.source, w.leaf, w.one, w.subroot"))
    return steps


def oracle_sql(levels: int = 5, over: int = 4) -> str:
    """For trees of up to 16 ** levels rows and 16 ** over sources."""
    def hashed(text: str) -> str:
        fields = "||".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({fields})"

    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return ",\n".join([
        f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, 0 AS one, doc_id, source, {hashed('text')} AS leaf,
  CASE WHEN ({crc32_sql('doc_id::VARCHAR')}) % 5 = 0 THEN {hashed(low)} ELSE {hashed('text')} END AS found FROM documents)""",
        """l0 AS MATERIALIZED (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx FROM d)""",
        *_levels_sql("l", "source", levels),
        f"o0 AS MATERIALIZED (SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx FROM l{levels})",
        *_levels_sql("o", "one", over),
        f"w0 AS (SELECT l0.row, l0.doc_id, l0.source, l0.leaf, l0.one, t.digest AS subroot, l0.idx AS pos, l0.found AS value, '' AS proof FROM l0 JOIN l{levels} t ON t.source IS NOT DISTINCT FROM l0.source)",
        *_climb_sql("w", "l", "source", levels),
        f"v0 AS (SELECT w.* EXCLUDE (pos), o0.idx AS pos FROM w{levels} w JOIN o0 ON o0.source IS NOT DISTINCT FROM w.source)",
        *_climb_sql("v", "o", "one", over),
    ]) + f"""
SELECT v.doc_id, v.source, v.leaf, v.subroot, o{over}.digest AS root, sha256(v.proof) AS proof_sha256, v.value AS folded_root,
  v.value = o{over}.digest AS verified FROM v{over} v JOIN o{over} ON o{over}.one = v.one"""
