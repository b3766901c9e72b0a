"""Secret scans with corpus-wide ownership frequency.

A first pass finds the matches in whole texts, with expressions of the JVM only: a
pattern's matches and the parts between them are listed in the same order, with their
lengths in code points. Values leave the pass as hashes. Matches are then rows: running
sums of the lengths, per document and kind, give positions, and running extremes of the
base spans' ends tell which wide tokens lie outside of them, so a text with many matches
takes time in proportion to them (and to sorting them).

The candidates of all documents are counted by distinct repositories and distinct owners.
A value that several owners have, or that many repositories have, is an example that was
copied around; one that a single owner has in few repositories and that looks random
counts as live. Tokens that no base pattern names (``wide``: 20 characters and more, with
letters and digits) are reported as ``owned`` spans where they are owner-specific and
live-looking, outside of base spans.

Defined cases: null or empty text has no spans; a null owner or repository counts as one
more value of its own, so that rows without one do not look owner-specific together with
others; repeated rows of a document are one repository; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmend.llm.common import stored


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The kinds with their patterns, in the order in which ties are listed.
ASSIGN = ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # whole runs, as a run is matched from its first character
WIDE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
#: So many owners, or so many repositories, make a value a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 20

_HIT = "struct<order:int,gap:int,length:int,value:string,live:boolean>"
_WIDE_START = "(?<![A-Za-z0-9+/_=-])"  # saves trying every character of a word


def _found(text: Column, pattern: str, order: int, keep, value) -> Column:
    """``pattern``'s matches in their order: the length of what stands before each since the
    last, its own length, and its value hashed, which is null where ``keep`` fails."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))

    def hit(gap: Column, match: Column) -> Column:
        secret = value(match)
        return F.struct(F.lit(order).alias("order"), F.length(gap).alias("gap"), F.length(match).alias("length"),
                        F.when(keep(match), F.sha2(secret, 256)).alias("value"), _random_looking(secret).alias("live"))

    return F.when(text.rlike(pattern), F.zip_with(between, matches, hit)).otherwise(F.array().cast(f"array<{_HIT}>"))


def _random_looking(value: Column) -> Column:
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``row``, ``doc_id``, ``owner``, ``repo``, ``hits`` of every row, without texts."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = lambda match: match
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
                       F.col(f"`{repo_col}`").cast("string").alias("repo"), text.alias("text"))
    assigned = lambda match: F.regexp_extract(match, ASSIGN, 2)
    hits = F.concat(
        _found(F.col("text"), ASSIGN, 0, lambda m: F.length(assigned(m)) >= ASSIGN_LENGTH, assigned),
        _found(F.col("text"), ACCESS, 1, lambda m: F.length(m) >= ACCESS_LENGTH, whole),
        _found(F.col("text"), HEX, 2, lambda m: F.lit(True), whole),
        _found(F.col("text"), _WIDE_START + WIDE, 3, _random_looking, whole))
    return rows.select("doc_id", "owner", "repo", hits.alias("hits")).withColumn("row", F.monotonically_increasing_id())


def candidates(found: DataFrame) -> DataFrame:
    """``row``, ``owner``, ``repo``, ``order``, ``start``, ``end``, ``value``, ``live``: a row for
    each base span, and for each wide one outside of those.

    A wide span is over a base one if a base span that starts no later ends after its start,
    or the next base span starts before its end. All windows have running frames over one
    distribution by ``row``."""
    place = W.partitionBy("row", "order").orderBy("at")
    upwards, downwards = W.partitionBy("row").orderBy("start", "order"), W.partitionBy("row").orderBy(F.desc("start"), F.desc("order"))
    base = F.col("order") < 3
    hits = found.select("row", "owner", "repo", F.posexplode("hits").alias("at", "hit")).select("row", "owner", "repo", "at", "hit.*")
    spans = hits.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(place).cast("int")) \
        .withColumn("start", F.col("end") - F.col("length")).where(F.col("value").isNotNull()) \
        .withColumn("reach", F.max(F.when(base, F.col("end"))).over(upwards)) \
        .withColumn("next", F.min(F.when(base, F.col("start"))).over(downwards))
    over = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return spans.where(base | ~over).select("row", "owner", "repo", "order", "start", "end", "value", "live")


def ownership(spans: DataFrame) -> DataFrame:
    """``value``, ``n_owners``, ``n_repos``: exact, and summed up before each shuffle, so a
    value that is everywhere costs one row a task."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.concat(F.lit("-"), F.col("row")))
    return spans.select("value", named("owner").alias("owner"), named("repo").alias("repo")) \
        .groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])))


def secret_spans(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, **columns: str) -> DataFrame:
    """For every row: counts of base spans by kind, their digest, all spans, and how many
    values are live-looking with one owner, or copied by several owners or many repositories."""
    found = stored(matches(docs, **columns), "secret-matches")
    placed = stored(candidates(found), "secret-spans")
    judged = placed.drop("owner", "repo").join(ownership(placed), "value") \
        .withColumn("copied", (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)) \
        .withColumn("own", F.col("live") & (F.col("n_owners") == 1) & ~F.col("copied")) \
        .where("order < 3 OR own") \
        .groupBy("row").agg(
            F.array_sort(F.collect_list(F.struct("start", "order", "end"))).alias("spans"),
            F.count_if("own").alias("n_live"), F.count_if("copied").alias("n_copied"), F.max("n_repos").alias("most_repos"))
    spans = F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:int,order:int,end:int>>"))
    base = F.filter("spans", lambda s: s["order"] < 3)
    of_kind = lambda order: F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long")
    return found.select("row", "doc_id").join(judged, "row", "left").withColumn("spans", spans).select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        of_kind(3).alias("n_owned"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_repos")))


def oracle_sql() -> str:
    """The same in DuckDB, for tables whose ids are unique and whose columns hold no null
    owner."""
    quoted = {k: v.replace("'", "''") for k, v in {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "wide": WIDE}.items()}
    scans = "\nUNION ALL\n".join(
        f"SELECT doc_id, source, {n} AS o, unnest(regexp_split_to_array(text, '{p}')) AS gap, "
        f"unnest(regexp_extract_all(text, '{p}')) AS val, "
        f"generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM t"
        for n, p in enumerate(quoted.values()))
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
scans AS ({scans}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(val), 0)) OVER (PARTITION BY doc_id, o ORDER BY i) AS e FROM scans),
cut AS (
  SELECT doc_id, source, o, CAST(e - length(val) AS INTEGER) AS s, CAST(e AS INTEGER) AS e,
    CASE WHEN o = 0 THEN regexp_extract(val, '{quoted["assign"]}', 2) ELSE val END AS v
  FROM placed WHERE val IS NOT NULL),
kept AS (
  SELECT *, length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM cut
  WHERE length(v) >= CASE o WHEN 0 THEN {ASSIGN_LENGTH} WHEN 1 THEN {ACCESS_LENGTH} ELSE 1 END),
cand AS (
  SELECT * FROM kept k WHERE o < 3 OR (live AND NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.doc_id = k.doc_id AND b.o < 3 AND b.s < k.e AND k.s < b.e))),
own AS (SELECT v, count(DISTINCT source) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM cand GROUP BY v),
judged AS (
  SELECT c.*, n_repos, n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOS} AS copied, live AND n_owners = 1 AND n_repos < {COPIED_REPOS} AS own
  FROM cand c JOIN own USING (v)),
listed AS (
  SELECT doc_id, o, s, own, copied, n_repos,
    (['assign', 'access', 'hex', 'owned'])[o + 1] || ':' || s || ':' || e AS name
  FROM judged WHERE o < 3 OR own),
docs AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    count(*) FILTER (o = 3) AS n_owned, count(*) FILTER (own) AS n_live, count(*) FILTER (copied) AS n_copied,
    max(n_repos) AS most_repos, string_agg(name, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(name, ',' ORDER BY s, o) AS spans
  FROM listed GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos
FROM t LEFT JOIN docs USING (doc_id)"""
