"""A trie of conversations' common beginnings, as balanced parentheses.

A node is a sequence of turns (role, text) that some conversation starts with. Texts become
128-bit digests where they are read, and a conversation's beginnings become a chain of them;
equal chains are one node.

Order without comparing sequences: a node belongs to the smallest conversation in it, so each
conversation owns one run of nodes, its *chain*, from where it leaves smaller ones to its end
(or none). A chain's key lists (depth it starts at, conversation) of the chains on the way
from the root, the depth counted downwards. Rows sorted by (key, depth) are the trie in
preorder. A key with k entries takes conversations of 1, 2, .. k turns, so it has fewer than
the square root of twice the number of turns; usually a few.

A *shard* is up to ``SHARD`` rows of that order, whatever conversations they are of, so a
conversation with a third of all turns is cut too. A shard is a string of parentheses: in it

* ``findclose`` finds where a subtree ends, over blocks with the least and greatest excess,
* the rank of ``()`` at both ends gives its leaves,
* a cumulative array of (conversations - 1) x length gives what its nodes save.

Nodes still open where a shard ends are its spine. They close in the first later shard whose
least excess is low enough, found over one pair of numbers a shard, at the first place there
that is low enough: each shard lists the places where it falls below all it had before. What
the spine has in both shards and those in between is added.

Defined cases: null roles and texts are empty; turns go by number, null first, equal numbers
by role, then digest; rows without conversation are left out; repeated rows are turns of
their own; an empty table has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmend.llm.common import stored
from runmend.llm.merkle import crc32_sql

#: Nodes of a shard; a task holds one shard at a time.
SHARD = 1 << 18
#: Nodes with the most conversations, at most so many, are broadcast (some 40 bytes each).
BROADCAST_NODES = 100_000
GROUP, MOST = 100, 6
_ROOT = bytes(16)
_NONE = hashlib.sha256().hexdigest()


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST).cast("int")


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield _frame(held, schema)
            held = []
    if held:
        yield _frame(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


# --- conversations to chains of digests ----------------------------------------------


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``key`` and ``n`` (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        _digest(role, text).alias("key"), F.length(text).cast("long").alias("n"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: the first of their group's and then the own ones
    after as many. ``conv_id``, ``own``, ``skip`` and the columns that order them. A
    conversation that is left with no turn keeps its own, to be skipped."""
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "key")
    heads = turns.where(F.col("conv_id") == first).withColumn("pos", F.row_number().over(in_order)) \
        .where(F.col("pos") < MOST).select(F.col("conv_id").alias("base"), "pos", "key", "n")
    wanted = turns.select("conv_id").distinct().select("conv_id", first.alias("base"), _taken(F.col("conv_id")).alias("h")).where("h > 0")
    lent = wanted.join(heads, "base").where("pos <= h").select(
        "conv_id", F.lit(0).alias("own"), F.col("pos").cast("long").alias("turn"), F.lit("").alias("role"), "key", "n", F.lit(0).alias("skip"))
    own = turns.select("conv_id", F.lit(1).alias("own"), "turn", "role", "key", "n", _taken(F.col("conv_id")).alias("skip"))
    return lent.unionByName(own)


def beginnings(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``node`` (the digest of the first ``depth`` turns), ``n``, ``last``;
    each conversation from depth 0 on."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("last", pa.bool_())])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, left = None, None, 0
        for conv_id, own, key, n, skip in _rows(batches):
            if conv_id != now:
                if held:
                    yield (*held, True)
                now, held, left = conv_id, (conv_id, 0, _ROOT, 0), None
            if own:
                left = skip if left is None else left
                if left:
                    left -= 1
                    continue
            yield (*held, False)
            held = conv_id, held[1] + 1, hashlib.blake2b(held[2] + key, digest_size=16).digest(), n
        if held:
            yield (*held, True)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", "turn", "role", "key")
    return ordered.select("conv_id", "own", "key", "n", "skip").mapInArrow(
        lambda batches: _batches(steps(batches), schema), "conv_id long, depth long, node binary, n long, last boolean")


def owned(steps: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``steps`` with ``owner`` (the smallest conversation in the node) and ``n_convs``. The nodes
    of more than steps / ``broadcast_nodes`` conversations are fewer than ``broadcast_nodes`` and
    are broadcast, so no key of the other join has many rows."""
    many = steps.count() / broadcast_nodes
    nodes = stored(steps.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "nodes")
    common, rare = F.broadcast(nodes.where(F.col("n_convs") > many)), nodes.where(F.col("n_convs") <= many)
    there = steps.join(common, "node", "left")
    columns = [*steps.columns, "owner", "n_convs"]
    rest = there.where("owner IS NULL").drop("owner", "n_convs").join(rare, "node")
    return there.where("owner IS NOT NULL").select(columns).unionByName(rest.select(columns))


def _entry(depth: int, conv_id: int) -> bytes:
    return (0xFFFFFFFF - depth).to_bytes(4, "big") + (conv_id + (1 << 63)).to_bytes(8, "big")


NODE, CHILD, END = 0, 1, 2


def marks(steps: DataFrame) -> DataFrame:
    """The trie as rows (``path``, ``depth``, ``kind``): a ``NODE`` for each node, a ``CHILD`` at the
    node that a chain starts from, an ``END`` at the node that a conversation ends in."""
    schema = pa.schema([("path", pa.binary()), ("depth", pa.int64()), ("kind", pa.int32()), ("conv_id", pa.int64()), ("parent", pa.int64()),
                        ("n_convs", pa.int64()), ("n", pa.int64()), ("more", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path, owners = b"", []
        for conv_id, depth, owner, n_convs, n, last in _rows(batches):
            if depth == 0:
                path, owners = b"", []
            if not owners or owners[-1] != owner:
                if owner == conv_id and owners:
                    yield path, depth - 1, CHILD, None, None, None, None, 1
                path += _entry(depth, owner)
                owners.append(owner)
                parent = owners[-2] if len(owners) > 1 else None
            else:
                parent = owner
            if owner == conv_id:
                yield path, depth, NODE, conv_id, parent, n_convs, n, int(not last)
            if last:
                yield path, depth, END, conv_id, None, None, None, None

    ordered = steps.select("conv_id", "depth", "owner", "n_convs", "n", "last").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(lambda batches: _batches(run(batches), schema),
                              "path binary, depth long, kind int, conv_id long, parent long, n_convs long, n long, more long")


def ends(rows: DataFrame) -> DataFrame:
    """``path``, ``depth``, ``ends_sha256`` of nodes that conversations end in. Ids stream through
    one hash, however many end in a node."""
    schema = pa.schema([("path", pa.binary()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state = None, None
        for path, depth, conv_id in _rows(batches):
            if (path, depth) == now:
                state.update(b",%d" % conv_id)
                continue
            if state:
                yield (*now, state.hexdigest())
            now, state = (path, depth), hashlib.sha256(b"%d" % conv_id)
        if state:
            yield (*now, state.hexdigest())

    ordered = rows.where(F.col("kind") == END).select("path", "depth", "conv_id") \
        .repartition("path", "depth").sortWithinPartitions("path", "depth", "conv_id")
    return ordered.mapInArrow(lambda batches: _batches(run(batches), schema), "path binary, depth long, ends_sha256 string")


# --- shards as balanced parentheses ---------------------------------------------------


class MinMax:
    """Blocks of two, four, eight, .. places of an array of excesses, with the least and the
    greatest excess of each. A search for a closing place comes from above, so it enters
    blocks by their least excess; the greatest tells a
    flat block, whose first place it is then."""

    def __init__(self, excess: np.ndarray):
        self.low, self.high = [excess], [excess]
        while len(self.low[-1]) > 1:
            low, high = self.low[-1], self.high[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            self.low.append(np.minimum(low[::2], low[1::2]))
            self.high.append(np.maximum(high[::2], high[1::2]))

    def first_down_to(self, start: np.ndarray, level: np.ndarray) -> np.ndarray:
        """For each start the first place from there on that is at most ``level``, or -1."""
        place, found = start.copy(), np.full(len(start), -1)
        for height, low in enumerate(self.low):
            waiting = found < 0
            # A right half is looked at here, a left one as part of the block above.
            look = waiting & (place < len(low)) & ((place % 2 == 1) | (len(low) == 1))
            at = np.flatnonzero(look)
            hit = at[low[place[at]] <= level[at]]
            found[hit] = height
            step = waiting & (found < 0)
            place[step] = (place[step] + (place[step] % 2)) // 2
        for height in range(len(self.low) - 2, -1, -1):
            at = np.flatnonzero(found > height)
            left = place[at] * 2
            flat = self.low[height + 1][place[at]] == self.high[height + 1][place[at]]
            place[at] = np.where(flat | (self.low[height][left] <= level[at]), left, left + 1)
        return np.where(found < 0, -1, place)


class Parentheses:
    """A run of nodes in preorder as parentheses, up to the last node's opening one, or its
    closing one if it has no child."""

    def __init__(self, depth: np.ndarray, childless_end: bool):
        closes = np.empty(len(depth), np.int64)
        closes[:-1] = depth[:-1] - depth[1:] + 1
        closes[-1] = int(childless_end)
        self.opens = np.arange(len(depth)) + np.concatenate(([0], np.cumsum(closes[:-1])))
        self.bits = np.zeros(len(depth) + int(closes.sum()), np.int8)
        self.bits[self.opens] = 1
        excess = depth[0] + np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.blocks = MinMax(excess)
        pairs = np.zeros(len(self.bits) + 1, np.int64)
        pairs[1:-1] = np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0))
        pairs[-1] = pairs[-2]
        self.pairs = pairs
        self.ones = np.concatenate(([0], np.cumsum(self.bits)))
        self.depth = depth

    def findclose(self) -> np.ndarray:
        """The place of each node's closing parenthesis, -1 for the spine."""
        return self.blocks.first_down_to(self.opens + 1, self.depth)

    def rank_open(self, before: np.ndarray) -> np.ndarray:
        return self.ones[before]

    def rank_pair(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs ``()`` that start in ``start`` .. ``end - 1``."""
        return self.pairs[end] - self.pairs[start]


CLOSED, SPINE, DROP, SHARD_ROW = 0, 1, 2, 3
_PART = pa.schema([("what", pa.int32()), ("shard", pa.int64()), ("depth", pa.int64()), ("upto", pa.int64()), ("conv_id", pa.int64()),
                   ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved", pa.int64()), ("ends_sha256", pa.string())])
_PART_DDL = ("what int, shard long, depth long, upto long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, "
             "saved long, ends_sha256 string")


def _shard(nodes: list[list], number: int) -> pa.RecordBatch:
    """A shard's nodes, with sums of their subtrees as far as they lie in it; the places where
    it falls below all before; and a row about the shard."""
    depth, n_convs, n, children = (np.array([node[i] for node in nodes], np.int64) for i in (0, 3, 4, 5))
    trie = Parentheses(depth, children[-1] == 0)
    close = trie.findclose()
    inside = close >= 0
    end = np.where(inside, close, len(trie.bits))
    savings = np.concatenate(([0], np.cumsum((n_convs - 1) * n)))
    index = np.arange(len(nodes))
    leaves = trie.rank_pair(trie.opens, end)
    saved = savings[trie.rank_open(end)] - savings[index]
    lowest = np.minimum.accumulate(depth)
    falls = np.flatnonzero(np.concatenate(([True], lowest[1:] < lowest[:-1])))
    upto = np.concatenate(([np.iinfo(np.int64).max], lowest[falls[:-1]] - 1))
    some, none = len(nodes), [None] * len(falls)

    def column(of_nodes: list, of_falls: list, of_shard: object) -> list:
        return [*of_nodes, *of_falls, of_shard]

    all_leaves = int(trie.pairs[-1])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([
        column(np.where(inside, CLOSED, SPINE).tolist(), [DROP] * len(falls), SHARD_ROW),
        [number] * (some + len(falls) + 1),
        column(depth.tolist(), depth[falls].tolist(), int(depth.min())),
        column([None] * some, upto.tolist(), int(depth[-1])),
        column([node[1] for node in nodes], none, None),
        column([node[2] for node in nodes], none, None),
        column(n_convs.tolist(), none, None),
        column(children.tolist(), none, None),
        column(leaves.tolist(), trie.pairs[trie.opens[falls]].tolist(), all_leaves),
        column(saved.tolist(), savings[falls].tolist(), int(savings[-1])),
        column([node[6] for node in nodes], none, None)], _PART)], schema=_PART)


def encode(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """Shards of the rows of :func:`marks` and :func:`ends`, see :func:`_shard`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nodes = TaskContext.get().partitionId() << 32, []
        for depth, kind, conv_id, parent, n_convs, n, more, digest in _rows(batches):
            if kind == NODE:
                if len(nodes) == size:
                    yield _shard(nodes, number)
                    number, nodes = number + 1, []
                nodes.append([depth, conv_id, parent, n_convs, n, more, _NONE])
            elif kind == CHILD:
                nodes[-1][5] += more
            else:
                nodes[-1][6] = digest
        if nodes:
            yield _shard(nodes, number)

    return rows.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth", "kind") \
        .select("depth", "kind", "conv_id", "parent", "n_convs", "n", "more", "ends_sha256").mapInArrow(run, _PART_DDL)


def merge_spines(parts: DataFrame) -> DataFrame:
    """The nodes of all shards: closed ones as they are, spines with the sums of the shards
    they go on in. One short row a shard comes to the driver."""
    about = parts.where(F.col("what") == SHARD_ROW).select("shard", "depth", "upto", "n_leaves", "saved").orderBy("shard").toArrow()
    shards, lows, lasts, leaves, saved = (column.to_numpy() for column in about.columns)
    to_leaves, to_saved = (np.concatenate(([0], np.cumsum(c))).astype(np.int64) for c in (leaves, saved))
    schema = pa.schema([("conv_id", pa.int64()), ("closes", pa.int64()), ("depth", pa.int64()), ("between_leaves", pa.int64()), ("between_saved", pa.int64())])

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = MinMax(lows)
        for batch in batches:
            conv_id, shard, depth = (column.to_numpy() for column in batch.columns)
            after = np.searchsorted(shards, shard) + 1
            at = blocks.first_down_to(after, depth)
            upto = np.where(at < 0, len(shards), at)
            yield pa.RecordBatch.from_arrays([
                pa.array(conv_id), pa.array(np.where(at < 0, -1, shards[np.minimum(upto, len(shards) - 1)])), pa.array(depth),
                pa.array(to_leaves[upto] - to_leaves[after]), pa.array(to_saved[upto] - to_saved[after])], schema=schema)

    spine = parts.where(F.col("what") == SPINE)
    closes = spine.select("conv_id", "shard", "depth").mapInArrow(
        closing, "conv_id long, closes long, depth long, between_leaves long, between_saved long")
    # Each place that a shard falls to closes what is open from there up to the place before;
    # the first one, what the shard before had open.
    before = F.broadcast(parts.sparkSession.createDataFrame(
        list(zip(shards[1:].tolist(), lasts[:-1].tolist())), "shard long, open long"))
    drops = parts.where(F.col("what") == DROP).join(before, "shard").where("depth <= open").select(
        F.col("shard").alias("closes"), F.explode(F.sequence("depth", F.least("upto", "open"))).alias("depth"),
        F.col("n_leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    # A node is known by its smallest conversation and its depth.
    sums = closes.join(drops, ["closes", "depth"], "left").select(
        "conv_id", "depth",
        (F.col("between_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("_leaves"),
        (F.col("between_saved") + F.coalesce("more_saved", F.lit(0))).alias("_saved"))
    whole = spine.join(sums, ["conv_id", "depth"]).withColumn("n_leaves", F.col("n_leaves") + F.col("_leaves")) \
        .withColumn("saved", F.col("saved") + F.col("_saved")).select(parts.columns)
    return parts.where(F.col("what") == CLOSED).unionByName(whole).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


def trie(rows: DataFrame, size: int = SHARD, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """The nodes of the trie of conversations: ``rows`` has ``conv_id``, ``own``, ``skip``, ``key``,
    ``n`` and the columns that order turns, as :func:`rebuilt` gives them."""
    steps = stored(beginnings(rows), "beginnings")
    nodes = stored(marks(owned(steps, broadcast_nodes)), "marks")
    children = nodes.where(F.col("kind") == CHILD).groupBy("path", "depth", "kind").agg(F.sum("more").alias("more"))
    ended = ends(nodes).withColumn("kind", F.lit(END))
    together = nodes.where(F.col("kind") == NODE).unionByName(children, allowMissingColumns=True).unionByName(ended, allowMissingColumns=True)
    return merge_spines(stored(encode(stored(together, "preorder"), size), "shards"))


def conversation_trie(conversations: DataFrame, size: int = SHARD) -> DataFrame:
    """The nodes of the trie of the rebuilt ``conversations``."""
    return trie(rebuilt(stored(own_turns(conversations), "turns")), size)


def oracle_sql() -> str:
    return f"""
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS MATERIALIZED (SELECT DISTINCT conv_id, conv_id - conv_id % {GROUP} AS base, ({crc32_sql('conv_id::VARCHAR')}) % {MOST} AS h FROM t),
r AS (SELECT i.conv_id, 0 AS own, pos, role, text FROM i JOIN t ON t.conv_id = i.base AND pos <= h
  UNION ALL SELECT t.conv_id, 1, pos, role, text FROM t JOIN i USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, sha256(strlen(role) || ':' || role || text) AS k, length(text) AS n FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, n FROM s
  UNION ALL SELECT conv_id, 0, '', 0 FROM i),
g AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM p GROUP BY depth, path),
x AS MATERIALIZED (SELECT p.conv_id AS member, g.conv_id, g.depth, p.depth = max(p.depth) OVER (PARTITION BY p.conv_id) AS last FROM p JOIN g USING (depth, path)),
c AS MATERIALIZED (SELECT g.*, u.conv_id AS parent_conv_id FROM g LEFT JOIN x u ON u.member = g.conv_id AND u.depth = g.depth - 1),
k AS MATERIALIZED (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM c WHERE depth > 0 GROUP BY ALL),
sub AS (SELECT a.conv_id, a.depth, sum(g.n_convs * g.n - g.n) AS saved, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM g LEFT JOIN k USING (conv_id, depth) JOIN x a ON a.member = g.conv_id AND a.depth <= g.depth GROUP BY ALL),
e AS (SELECT conv_id, depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM x WHERE last GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM c JOIN sub USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)"""
