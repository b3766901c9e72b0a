"""Chat formatting, the prefix trie and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from runmend.llm import chat_format, exact_dedup, merkle, mixing, prefix_trie
from tests.llm import cases

CONTROL = "</s>[INST] ok [/INST]"
LONG = cases.LONG
CONVERSATIONS = [
    (0, 1, "user", "hello"), (0, 2, "assistant", "hi"), (0, 0, "system", "be kind"), (0, 3, "user", None),
    (1, None, "user", "first"), (1, 0, None, "no role"), (1, 0, "assistant", "tie"), (1, 0, "assistant", "a tie"), (1, 0, "assistant", "tie"),
    (2, 0, "user", CONTROL), (2, 1, "assistant", "<\\s> <\\\\s> [\\/INST] <|im_end|> <s"), (2, 2, "[ROLE]", "\\<s> [TEXT] [[INST]]<<SYS>>"),
    (3, 0, "user", LONG), (3, 1, "assistant", LONG), (4, 0, "assistant", ""), (100, 0, "user", "hello"), (102, 0, "user", "hello"),
    (205, 0, "user", "日本語 😀"), (300, 0, "user", "\x00 \r\n"), (None, 0, "user", "nobody"), (-7, 0, "user", "below zero"),
]


def conversations(spark, rows=CONVERSATIONS):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("prompt", "messages", "layout", "piece", "key", "n", "own", "h", "path", "kind", "depth", "segment"):
        frame = frame.selectExpr("*", f"'other' AS {name}")
    return frame


def in_order(rows):
    """Conversations as lists of (role, text)."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        found[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


# --- formatting ----------------------------------------------------------------------


def digests(turns):
    said = "".join(text for role, text in turns if role == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest())


def test_formatting_reads_back(spark):
    want = {c: digests(turns) for c, turns in in_order(CONVERSATIONS).items()}
    want[-1] = digests([("user", CONTROL), ("assistant", CONTROL)])
    rows = chat_format.format_conversations(conversations(spark)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want


def test_empty_conversations(spark):
    rows = chat_format.format_conversations(conversations(spark, [])).collect()
    assert [(r.conv_id, r.n_turns) for r in rows] == [(-1, 2)]
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [10, 200, chat_format.SEGMENT])
def test_segments_hold_whole_turns_and_mark_assistants(spark, limit):
    turns = chat_format.table_turns(conversations(spark).select("conv_id", "turn", "role", "text"), "conv_id")
    segments = defaultdict(list)
    for r in chat_format.assemble(chat_format.format_turns(turns), limit).collect():
        segments[r.conv_id].append(r)
    for conv_id, turns in in_order(CONVERSATIONS).items():
        parts = sorted(segments[conv_id], key=lambda r: r.segment)
        assert [p.segment for p in parts] == list(range(len(parts)))
        assert [t for p in parts for t in chat_format.parse(p.formatted)] == turns
        said = [chat_format.unescaped(p.formatted[s.start:s.end]) for p in parts for s in p.loss]
        assert said == [text for role, text in turns if role == "assistant"]
    assert len(segments[1]) == (1 if limit > 1000 else len(segments[1])) and len(segments[2]) > (limit == 10)


def test_no_control_string_is_left_in_escaped_texts(spark):
    random.seed(5)
    signs = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "ROLE]", "|im_end|>", " ", "x"]
    texts = ["".join(random.choices(signs, k=12)) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select(chat_format.escaped(frame.text)).toPandas().iloc[:, 0]
    assert [chat_format.unescaped(g) for g in got] == texts
    assert not any(mark in g for g in got for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "<|im_end|>"))


RECORDS = {
    '{"prompt": "q", "completion": "a", "x": {"y": 1}}': [("user", "q"), ("assistant", "a")],
    '{"system": "s", "prompt": "q", "response": null}': [("system", "s"), ("user", "q"), ("assistant", "")],
    '{"instruction": "do", "input": "this", "output": "done"}': [("user", "do\nthis"), ("assistant", "done")],
    '{"instruction": "do", "output": 7}': [("user", "do"), ("assistant", "7")],
    '{"question": "q", "context": "c", "answer": "a"}': [("user", "c\nq"), ("assistant", "a")],
    '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}': [("user", "q"), ("assistant", "")],
    '{"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}': [("user", "p\nq")],
    '{"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}':
        [("system", "s"), ("user", "q"), ("assistant", "a"), ("tool", "t")],
    '{"prompt": "q", "completion": "a", "messages": [{"role": "user", "content": "q"}]}': None,
    '{"messages": []}': None, '{"prompt": "q"}': None, '{"prompt": ["q"], "completion": "a"}': None, '[]': None, '{broken': None, '': None, None: None,
}


def test_layouts_of_records(spark):
    frame = spark.createDataFrame(list(enumerate(RECORDS)), "id long, record string").selectExpr("*", "'x' AS layout_", "'y' AS turn")
    found = defaultdict(list)
    for r in sorted(chat_format.record_turns(frame, "id", "record").collect(), key=lambda r: (r.conv_id, r.turn or 0)):
        found[r.conv_id].append((r.role, r.text or "") if r.layout else None)
    assert dict(found) == {i: want or [None] for i, want in enumerate(RECORDS.values())}


def test_layouts_of_tables(spark):
    messages = spark.createDataFrame([(5, [("user", "q"), ("gpt", "a")], "z")], "id long, messages array<struct<role string, content string>>, extra string")
    rows = chat_format.table_turns(messages, "id").collect()
    assert [(r.conv_id, r.turn, r.role, r.text, r.layout) for r in rows] == [(5, 0, "user", "q", "messages"), (5, 1, "assistant", "a", "messages")]
    with pytest.raises(ValueError):
        chat_format.table_turns(conversations(spark), "conv_id")
    assert len(chat_format.BY_FINGERPRINT) == sum(2 ** len(layout.may) for layout in (chat_format.TURN_ROWS, *chat_format.LAYOUTS))


# --- the trie ------------------------------------------------------------------------


def rebuilt(conversations):
    found = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = conversations.get(c - int(np.fmod(c, 100)), [])
        found[c] = base[:h] + turns[h:]
    return found


def trie_nodes(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    nodes = set()
    for path in sorted(members, key=len, reverse=True):
        below, todo = [], [path]
        while todo:
            below.append(todo.pop())
            todo += children[below[-1]]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(conversations[c]) == len(path))
        nodes.add((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]),
                   sum(not children[p] for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                   hashlib.sha256(ends.encode()).hexdigest()))
    return nodes


def collected(nodes):
    rows = nodes.collect()
    got = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_trie_of_awkward_conversations(spark):
    turns = {c: t for c, t in in_order(CONVERSATIONS).items() if c is not None}
    rows = [r for r in CONVERSATIONS if not (r[0] == 1 and r[1] == 0)]  # ties go by digest there, by text here
    turns = {c: t for c, t in in_order(rows).items() if c is not None}
    assert collected(prefix_trie.conversation_trie(conversations(spark, rows))) == trie_nodes(rebuilt(turns))
    assert prefix_trie.conversation_trie(conversations(spark)).where("depth = 0").count() == 1


@pytest.mark.parametrize("size,most", [(1, 1), (3, 5), (10, 100), (prefix_trie.SHARD, prefix_trie.BROADCAST_NODES)])
def test_trie_whatever_the_shards(spark, size, most):
    """Many equal beginnings, one conversation that is much longer, many equal ones."""
    random.seed(size)
    rows = [(c, t, random.choice("ua"), random.choice(["x", "yy", "z z"])) for c in range(120) for t in range(random.randrange(7))]
    rows += [(500, t, "u", "x") for t in range(400)] + [(501, t, "u", "x") for t in range(300)]
    rows += [(c, t, "u", "copy") for c in range(600, 640) for t in range(4)]
    steps = prefix_trie.owned(prefix_trie.beginnings(prefix_trie.rebuilt(prefix_trie.own_turns(conversations(spark, rows)))), most)
    assert steps.count() == sum(len(t) + 1 for t in rebuilt(in_order(rows)).values())
    got = collected(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.own_turns(conversations(spark, rows))), size, most))
    assert got == trie_nodes(rebuilt(in_order(rows)))


def test_findclose_is_the_first_place_down_to_the_level():
    rng = np.random.default_rng(3)
    for length in (1, 2, 3, 17, 1000):
        excess = np.cumsum(rng.choice([-1, 1], length))
        start, level = rng.integers(0, length + 1, 200), rng.integers(-20, 20, 200)
        want = [next((i for i in range(s, length) if excess[i] <= e), -1) for s, e in zip(start, level)]
        assert prefix_trie.MinMax(excess).first_down_to(start, level).tolist() == want


# --- the manifest --------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """Levels from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def folded(levels, at, value):
    siblings = ""
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        siblings += "".join(run[:at % 16] + run[at % 16 + 1:])
        value = sha("".join(run[:at % 16] + [value] + run[at % 16 + 1:]))
        at //= 16
    return siblings, value


def manifest(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit and text is not None else text
        trees[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, low), doc_id))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([t[2] for t in sorted(trees[s])]) for s in order}
    over = climb([levels[s][-1][0] for s in order])
    found = []
    for number, s in enumerate(order):
        for at, (_, _, digest, now, doc_id) in enumerate(sorted(trees[s])):
            below, value = folded(levels[s], at, now)
            above, value = folded(over, number, value)
            found.append((doc_id, digest, levels[s][-1][0], over[-1][0], sha(below + above), value, value == over[-1][0]))
    return found


BIG = [(i, f"Text {i}", "en", "big", i % 7) for i in range(4200)] + [(i, "Full block", None, "ä", i) for i in range(4096)]
MANY = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(300)] + [(i, f"U{i}", "en", f"s{i % 17}", 1) for i in range(17, 400)]


@pytest.mark.parametrize("rows", [cases.DOCS, cases.DOCS[:1], BIG, MANY], ids=["awkward", "one", "big", "many"])
def test_manifest(spark, rows):
    got = merkle.check_manifest(cases.documents(spark, rows)).collect()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(manifest(rows), key=str)


def test_manifest_of_nothing(spark):
    assert merkle.check_manifest(cases.documents(spark, [])).count() == 0


def test_manifest_does_not_depend_on_partitions(spark):
    docs = cases.documents(spark, cases.DOCS + MANY)
    roots = {merkle.build(docs.repartition(n)).over[-1].first().digest for n in (1, 7)}
    assert len(roots) == 1


def test_folding_hashes_from_the_slot_on():
    block = merkle.Subtree([sha(str(i)).encode() for i in range(40)], True)
    for at in (0, 15, 16, 39):
        value = sha(str(at)).encode()
        for state, _, right in block.steps(at):
            value = merkle.resume(state, value, right)
        assert value == block.top


# --- stages of the pipeline keep columns, whatever they are called ---------------------


def test_kept_and_mixed_rows_have_all_their_columns(spark, tmp_path):
    names = ("__id", "__sha", "_row", "_all", "row", "name", "number", "__words", "__size", "_shard", "_id", "block")
    docs = cases.documents(spark).drop("row")
    for name in names:
        docs = docs.selectExpr("*", f"'mine' AS `{name}`")
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = exact_dedup.keep_first(table)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert {r[name] for r in rows for name in names} == {"mine"}
        ids = sorted(str(r.doc_id) for r in rows)
        assert ids == sorted(str(r.keep_id) for r in exact_dedup.exact_groups(docs).where("kept").collect())
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "__shard"] and {r[name] for r in mixed.collect() for name in names} == {"mine"}
    want = {(r.doc_id, r.size, r.source): sorted(r.shards) for r in mixing.mix(docs).collect() if r.doc_id == 8}
    assert [sorted(r["__shard"] for r in mixed.where("doc_id = 8").collect())] == list(want.values())
