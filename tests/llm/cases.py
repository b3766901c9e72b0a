"""Small tables with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import regex

from runmend.llm import licenses as licences
from runmend.llm import secret_scan

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old stone bridges in quiet towns".split()
LONG = " ".join(WORDS[(i * i) % len(WORDS)] + str(i % 97) for i in range(30_000))
BASE = " ".join(WORDS * 3)

DOCS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1),  # a copy, and the same row twice
    (3, BASE.replace(" ", "\n\t "), "en", "b", 1),  # equal but for white space
    (4, BASE.upper() + " end", "en", "b", 1),  # a near copy
    (5, None, "en", "c", None), (6, "", None, "c", 0), (7, " \n\t", "de", None, 3),
    (8, LONG, "en", None, 9), (None, "no id here", "en", "a", 2), (None, None, None, None, None),
    (9, "x", "de", "d", 1), (10, "Wörter 日本語 😀 \U0001F600 café", "de", "d", 4),
    (11, "12345 !!! 678", "en", "d", 3), (12, "  two   spaces  ", "en", "e", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    """With more columns, whose names operators use themselves."""
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("hash", "ids", "n", "row", "size", "family", "score", "kept", "shard", "a", "b"):
        frame = frame.selectExpr("*", f"'other' AS {name}")
    return frame


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def near_copies(rows, width, percent):
    """id to (number of shingles, component), by all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((x, y) for ids in holders.values() for x in ids for y in ids if x < y)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, y), c in shared.items():
        if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def mixed_targets(sizes: dict):
    """Targets by sharing the excess again and again."""
    weight = {n: [1, 2, 3][i % 3] for i, n in enumerate(sorted(sizes, key=lambda n: (n is None, n or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in full)
        rest = sum(weight[n] for n in sizes if n not in full)
        target = {n: 3 * sizes[n] if n in full else left * weight[n] / rest for n in sizes}
        over = [n for n in sizes if n not in full and target[n] > 3 * sizes[n]]
        if not over:
            return target
        full.update(over)


def licenses(text):
    """The best licence, its Dice, all names and the number of matches: every unit and every
    window against every template."""
    templates = [(order, name, set(b), len(re.findall(r"[^\W_]+", full.lower())) - 1 - len(b))
                 for order, (name, full) in enumerate(sorted(licences.TEMPLATES)) for b in [licences.template_bigrams(full)]]
    words_of = lambda unit: regex.sub(r"[^\p{L}\p{N}]+", " ", unit).split()
    dice = lambda shared, size, other: 2 * shared / (size + other)

    def best(unit):
        words = words_of(unit)
        bigrams = {" ".join(pair) for pair in zip(words, words[1:])}
        scored = [(-dice(len(bigrams & b), len(bigrams), len(b)), order, name) for order, name, b, _ in templates if bigrams]
        return sorted(s for s in scored if s[0] <= -licences.THRESHOLD)[:1]

    found, rest = [], []
    for paragraph in regex.split(r"\n[^\n\p{L}\p{N}]*\n", text.lower()):
        lines = paragraph.split("\n")
        whole = best(paragraph) if len(lines) > 1 else []
        found += whole + [m for line in lines for m in best(line)]
        rest += ["|"] if whole else [w for line in lines for w in (["|"] if best(line) else words_of(line))]
    bigrams = [" ".join(pair) for pair in zip(rest, rest[1:])]
    windows = []
    for order, name, b, repeated in templates:
        longest = licences.size_bounds(len(b), licences.THRESHOLD)[1] + repeated
        for start in (i for i, bigram in enumerate(bigrams) if bigram in b):
            for stop in range(start, min(start + longest, len(bigrams))):
                window = set(bigrams[start:stop + 1])
                if bigrams[stop] in b and dice(len(window & b), max(len(window), len(b)), len(b)) >= licences.THRESHOLD:
                    windows.append((-dice(len(window & b), max(len(window), len(b)), len(b)), order, name, start, stop))
    kept = []
    for w in sorted(windows):
        if all(w[4] + 1 < k[3] or k[4] + 1 < w[3] for k in kept):
            kept.append(w)
    found += [w[:3] for w in kept]
    first = min(found, default=(None, None, None))
    return first[2], -first[0] if found else None, ",".join(sorted({f[2] for f in found})), len(found)


def secrets(texts, owners):
    """Per text: its spans, and the numbers of live-looking and of copied values."""
    live = lambda v: len(v) >= 16 and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v))
    spans = []
    for row, text in enumerate(texts):
        base = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(secret_scan.ASSIGN, text or "") if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        covered = {at for start, _, end, _ in base for at in range(start, end)}
        wide = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or "")]
        spans.append(sorted(base + [w for w in wide if live(w[3]) and not covered.intersection(range(w[0], w[2]))]))
    seen, repos = defaultdict(set), defaultdict(set)
    for row, (listed, owner) in enumerate(zip(spans, owners)):
        for *_, value in listed:
            seen[value].add(owner if owner is not None else row)
            repos[value].add(row)
    copied = lambda v: len(seen[v]) >= secret_scan.COPIED_OWNERS or len(repos[v]) >= secret_scan.COPIED_REPOS
    own = lambda v: live(v) and len(seen[v]) == 1 and not copied(v)
    result = []
    for listed in spans:
        shown = [s for s in listed if s[1] < 3 or own(s[3])]
        result.append((",".join(f"{secret_scan.KINDS[order]}:{start}:{end}" for start, order, end, _ in shown),
                       sum(own(s[3]) for s in shown), sum(copied(s[3]) for s in shown)))
    return result
