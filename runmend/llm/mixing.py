"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Targets share the total by weight and stop at ``MAX_PASSES`` times their
source; what a stop frees goes to the others by weight (a level found on sorted ratios).

A source's documents are dealt into ``BLOCKS`` blocks by a hash. Its target is so many
whole passes over the blocks and a rest: blocks of a permutation until the next would
exceed the rest, documents of that next block in permuted order, then up to
``TOP_UPS`` single documents whose size is nearest to what still lacks.

The numbers of block draws per source are the root of the tree. Every node cuts its draws
in two halves of exact size by a random order, so the numbers per source on either side
are a draw from the multivariate hypergeometric distribution; after
``DEPTH`` levels the leaves are the output shards. Each shard then takes its number of a
source's draws, disjoint ranges of that source's permuted draws, and is shuffled locally.

Only the plan (sources x blocks rows, whatever the corpus) passes through ranks; documents
meet it by (source, block), which spreads a source that holds a third of all rows.

Defined cases: null text has no words; a null source is a source, the last one; a source
without words has target 0 and is not drawn; rows that share id, source and size share
their number of copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmend.llm.common import stored, word_count

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
BLOCKS = 1024
DEPTH = 5
SEED = 7
TOP_UPS = 3
#: Ranges of random keys that the draws of a level of the tree are counted in.
RANGES = 1 << 12
#: Up to so many sources their one-row-a-source tables are broadcast.
BROADCAST_SOURCES = 10_000
#: Up to so many draws of blocks, and of single documents (some 60 bytes each), are broadcast.
BROADCAST_DRAWS = 200_000


def _random(*what: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *what)


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``number``, ``source_size``, ``target``, ``passes``, ``rest``; a row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "number")
    weights = F.array(*map(F.lit, WEIGHTS))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("number", F.row_number().over(by_name)) \
        .withColumn("weight", F.get(weights, (F.col("number") - 1) % len(WEIGHTS)).cast("double")) \
        .withColumn("cap", (MAX_PASSES * F.col("source_size")).cast("double")) \
        .withColumn("total", F.sum("source_size").over(whole).cast("double")) \
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))) \
        .withColumn("stopped", F.col("cap") <= F.col("left") / F.col("weight_left") * F.col("weight"))
    level = F.max(F.when(~F.col("stopped"), F.struct(-F.col("cap") / F.col("weight"), -F.col("number"), (F.col("left") / F.col("weight_left")).alias("level")))).over(whole)["level"]
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(level * F.col("weight"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_PASSES))).otherwise(0).cast("int")
    return per.withColumn("target", target).withColumn("passes", passes) \
        .withColumn("rest", F.when(F.col("passes") < MAX_PASSES, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)) \
        .select("source", "number", "source_size", "target", "passes", "rest")


def block_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``number``, ``block``, ``copies``, ``room``: how often a whole block is drawn, and
    how many words of it fit in when it is the one that the rest ends in."""
    permuted = W.partitionBy("number").orderBy(_random("number", "block"), "block")
    blocks = rows.groupBy("number", "block").agg(F.sum("size").alias("words")) \
        .join(sources.select("number", "passes", "rest"), "number") \
        .withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fits = F.col("before") + F.col("words") <= F.col("rest")
    room = F.when(~fits & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before"))
    return blocks.select("number", "block", (F.col("passes") + fits.cast("int")).alias("copies"), room.alias("room"))


def split(quotas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``quotas`` (``number``, ``n``) dealt to 2**depth shards: ``shard``, ``number``, ``n``.

    The draws of a node have random keys, and the half with the smaller ones goes left. Which
    draws these are is told by counting them by range of the key: ranges below the middle go
    left whole, those above it right, and only the one range that holds it is ranked. A level
    has ``RANGES`` ranges over all its nodes, so no task sees more than that share of the
    draws, and the counts that are broadcast do not grow with them."""
    level = quotas.withColumn("node", F.lit(0))
    by_range = W.partitionBy("node").orderBy("range")
    for at in range(depth):
        shift = 64 - max(RANGES.bit_length() - 1 - at, 1)
        draws = level.select("node", "number", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("unit")) \
            .withColumn("key", _random(F.lit(at), "node", "number", "unit")).withColumn("range", F.shiftright("key", shift))
        counts = draws.groupBy("node", "range").agg(F.count("*").alias("here")) \
            .withColumn("before", F.sum("here").over(by_range) - F.col("here")).withColumn("all", F.sum("here").over(W.partitionBy("node"))) \
            .withColumn("left", F.floor((F.col("all") + (F.col("all") + F.col("node")) % 2) / 2)) \
            .withColumn("lefts", F.greatest(F.least(F.col("left") - F.col("before"), F.col("here")), F.lit(0)))
        met = draws.join(F.broadcast(counts.select("node", "range", "here", "lefts")), ["node", "range"])
        cut = (F.col("lefts") > 0) & (F.col("lefts") < F.col("here"))
        ranked = W.partitionBy("node", "range").orderBy("key", "number", "unit")
        right = met.where(~cut).select("node", "number", (F.col("lefts") == 0).alias("right")).unionByName(
            met.where(cut).withColumn("rank", F.row_number().over(ranked)).select("node", "number", (F.col("rank") > F.col("lefts")).alias("right")))
        level = stored(right.groupBy((F.col("node") * 2 + F.col("right").cast("int")).alias("node"), "number").agg(F.count("*").alias("n")), "split")
    return level.withColumnRenamed("node", "shard")


def draw_blocks(plan: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``number``, ``block``, ``shards`` (of its whole copies), ``last_shard`` (of a partial
    one): every draw of a block in the shard that took it."""
    draws = plan.select("number", "block", "copies", (F.col("copies") + F.col("room").isNotNull().cast("int")).alias("all")) \
        .where(F.col("all") > 0).select("*", F.explode(F.sequence(F.lit(1), F.col("all"))).alias("copy")) \
        .withColumn("place", F.row_number().over(W.partitionBy("number").orderBy(_random(F.lit("draw"), "number", "copy", "block"), "copy", "block")))
    quotas = split(draws.groupBy("number").agg(F.count("*").alias("n")), depth)
    to = F.sum("n").over(W.partitionBy("number").orderBy("shard"))
    places = quotas.withColumn("to", to.cast("int")).withColumn("from", F.col("to") - F.col("n").cast("int") + 1) \
        .select("number", "shard", F.explode(F.sequence("from", "to")).alias("place"))
    return draws.join(places, ["number", "place"]).groupBy("number", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("copy") <= F.col("copies"), F.col("shard")))).alias("shards"),
        F.max(F.when(F.col("copy") > F.col("copies"), F.col("shard"))).alias("last_shard"))


def _block(doc_id: Column) -> Column:
    return F.pmod(_random(doc_id), F.lit(BLOCKS)).cast("int")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, depth: int) -> DataFrame:
    """A narrow row for each document, with the draws of its block and whether it is drawn
    once more by itself (``extra``), for the shard ``last``."""
    sizes = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                               word_count(F.col(f"`{text_col}`").cast("string")).alias("size")), "sizes")
    sources = stored(targets(sizes), "targets")
    few = sources.count() <= BROADCAST_SOURCES
    beside = lambda df: F.broadcast(df) if few else df
    named = beside(sources.withColumnRenamed("source", "__source"))
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source") \
        .withColumn("block", _block(F.col("doc_id")))
    plan = stored(block_plan(rows, sources), "plan")
    drawn = plan.join(draw_blocks(plan, depth), ["number", "block"], "left")
    in_block = W.partitionBy("number", "block").orderBy(_random(F.lit("in"), "doc_id"), "doc_id", "size")
    met = rows.join(drawn, ["number", "block"])
    # Only documents of the blocks that a rest ends in are ranked, one block a source.
    ends = met.where("room IS NOT NULL").withColumn("extra", F.sum("size").over(in_block) <= F.col("room"))
    # The word counts of equal rows differ in rank only; all follow the least favoured one.
    same = W.partitionBy("number", "block", "doc_id", "size")
    ends = ends.withColumn("extra", F.min("extra").over(same) & (F.col("size") > 0))
    held = stored(met.where("room IS NULL").withColumn("extra", F.lit(False)).unionByName(ends)
                  .withColumn("partial", F.col("copies") > F.col("passes")), "mixed")
    for _ in range(TOP_UPS):
        given = F.when(F.col("extra") | F.col("partial"), F.col("size")).otherwise(0)
        lacks = held.groupBy("number").agg((F.first("rest") - F.sum(given)).alias("lacks"))
        off = F.abs(F.col("lacks") - F.col("size"))
        free = (F.col("copies") < MAX_PASSES) & ~F.col("extra") & ~F.col("partial") & (F.col("size") > 0)
        nearest = held.where(free).join(beside(lacks), "number").where(off < F.col("lacks")) \
            .groupBy("number").agg(F.min(F.struct(off, _random(F.lit("top"), "doc_id"), "doc_id", "size")).alias("pick")) \
            .select("number", F.col("pick.doc_id").alias("__id"), F.col("pick.size").alias("__size"))
        held = stored(held.join(beside(nearest), "number", "left").withColumn(
            "extra", F.col("extra") | (free & F.coalesce(F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size")), F.lit(False))))
            .drop("__id", "__size"), "mixed")
    last = F.coalesce("last_shard", F.pmod(_random(F.lit("shard"), "doc_id"), F.lit(2**depth)).cast("int"))
    return held.withColumn("last", last).withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``shards`` and
    ``source`` for every row."""
    copies = F.col("copies") + F.col("extra").cast("int")
    return _drawn(docs, id_col, text_col, source_col, depth).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"),
        F.when(F.col("extra"), F.concat("shards", F.array("last"))).otherwise(F.col("shards")).alias("shards"), "source")


def mixture(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeated by their copies, dealt to their
    shards, each shard in random order. All their columns, whatever these are called, and
    ``__shard``, the last one.

    Documents learn their copies from the draws of their block, of which there are sources x
    ``BLOCKS`` at most, and from the list of single draws, one block and a few documents a
    source. Both are broadcast up to a bound, so that whole rows move once, to their shard."""
    drawn = stored(_drawn(docs, "doc_id", "text", "source", depth).select("doc_id", "source", "size", "block", "shards", "extra", "last"), "drawn")
    blocks = stored(drawn.groupBy("source", "block").agg(F.first("shards").alias("shards")).where(F.size("shards") > 0)
                    .select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("shards").alias("_shards")), "blocks")
    single = stored(drawn.where("extra").groupBy("doc_id", "source", "size").agg(F.max("last").alias("_last"))
                    .select(F.col("doc_id").alias("_one"), F.col("source").alias("_of"), F.col("size").alias("_size"), "_last"), "single")
    beside = lambda df: F.broadcast(df) if df.count() <= BROADCAST_DRAWS else df
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    doc_id, source = F.col("_all")["doc_id"], F.col("_all")["source"].cast("string")
    keyed = rows.select("_all", doc_id.alias("_id"), source.alias("_from"), _block(doc_id).alias("_in"), word_count(F.col("_all")["text"].cast("string")).alias("_words"))
    met = keyed.join(beside(blocks), F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_in") == F.col("_block")), "left") \
        .join(beside(single), F.col("_id").eqNullSafe(F.col("_one")) & F.col("_from").eqNullSafe(F.col("_of")) & (F.col("_words") == F.col("_size")), "left")
    none = F.array().cast("array<int>")
    shards = F.concat(F.coalesce("_shards", none), F.when(F.col("_last").isNotNull(), F.array("_last")).otherwise(none))
    return met.select("_all", "_id", F.posexplode(shards).alias("_copy", "_shard")) \
        .withColumn("_order", _random(F.lit("order"), "_id", "_shard", "_copy")) \
        .repartition("_shard", F.col("_order") % 64).sortWithinPartitions("_shard", "_order").select("_all.*", F.col("_shard").alias("__shard"))
