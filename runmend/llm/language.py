"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built, so every substring of
that text is a path from its start. A document is cut into phrases, each the longest that
occurs in the language's text; the language that needs the fewest phrases per letter wins.

The sample is bounded: of each language the ``TEXTS`` rows with the lowest hash of their
id, ``LETTERS`` characters in all at most, an equal share of each row (fewer when there are many languages, so that
all automata together have a bounded table, which is broadcast). Documents are parsed
whole. Windows of ``WINDOW`` letters are parsed side by side, as one step of an array
program; a phrase ends with its window, for every language alike.

Text is reduced to its letters in lower case, with one blank for whatever stands between.
Defined cases: null text, and text without a letter, is ``und`` with score 0, as is every
text when nothing could be learned; languages with equal counts: the first by name wins;
rows with null id or null language are not learned from; repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmend.llm.common import by_pieces, held_out

TEXTS = 120
LETTERS = 16_000
ALL_LETTERS = 256_000
SYMBOLS = 128
WINDOW = 512
UNDETERMINED = "und"
_LANES = 4096


@cache
def _folded() -> np.ndarray:
    """For every code point its letter in lower case, 0 where it is no letter."""
    of = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            of[code] = ord(letter.lower()[0])
    return of


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, reduced, and how many each text has. A text starts with a
    blank, so that its first word looks like any other."""
    joined = "\0".join(t or "" for t in texts)
    sizes = np.array([len(t or "") + 1 for t in texts])
    codes = _folded()[np.frombuffer((joined + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    codes = np.r_[np.uint32(0), codes[:-1]] if len(codes) else codes  # the blank after a text starts the next
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (doc[1:] != doc[:-1])
    return codes[keep], np.bincount(doc[keep], minlength=len(texts))


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """For every state of the automaton of all substrings, its transitions by symbol."""
    to: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in symbols.tolist():
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in to[at]:
            to[at][symbol] = new
            at = link[at]
        if at >= 0:
            found = to[at][symbol]
            if length[found] == length[at] + 1:
                link[new] = found
            else:
                copy = len(to)
                to.append(dict(to[found]))
                length.append(length[at] + 1)
                link.append(link[found])
                link[found] = link[new] = copy
                while at >= 0 and to[at].get(symbol) == found:
                    to[at][symbol] = copy
                    at = link[at]
        last = new
    return to


@dataclass(frozen=True)
class Languages:
    """Automata of all languages, each at its own offset. Every code point of a sample is a
    symbol. Ways on by the most frequent ones are in a table; those by the others, which
    all have the table's last column, are found by their key, state and symbol as one
    number, among sorted keys."""

    names: list[str]
    alphabet: np.ndarray  # sorted folded code points of the samples
    symbols: np.ndarray  # of each of these
    table: np.ndarray
    keys: np.ndarray
    ways: np.ndarray
    starts: np.ndarray

    def symbols_of(self, codes: np.ndarray) -> np.ndarray:
        """A code point that no sample has is the symbol after all others, without ways on."""
        different, at = np.unique(codes, return_inverse=True)
        place = np.minimum(np.searchsorted(self.alphabet, different), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == different, self.symbols[place], _unknown(self.alphabet))[at]

    def _way(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """From each state (lane x language) by its lane's symbol."""
        after = self.table.reshape(-1)[state * SYMBOLS + np.minimum(symbol, SYMBOLS - 1)[:, None]]
        rare = np.flatnonzero((symbol >= SYMBOLS - 1) & (symbol < _unknown(self.alphabet)))
        if len(rare) and len(self.keys):
            key = state[rare] * _unknown(self.alphabet) + symbol[rare][:, None]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            after[rare] = np.where(self.keys[place] == key, self.ways[place], after[rare])
        return after

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of phrases, text x language."""
        counts = np.zeros((len(sizes), len(self.names)), np.int64)
        if not len(self.names) or not len(codes):
            return counts
        symbols = self.symbols_of(codes)
        begin = np.cumsum(sizes) - sizes
        windows = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = begin[doc] + nth * WINDOW
        length = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
        order = np.argsort(-length, kind="stable")
        for lanes in np.split(order, range(_LANES, len(order), _LANES)):
            found = self._parse(symbols, start[lanes], length[lanes])
            for language in range(len(self.names)):
                counts[:, language] += np.bincount(doc[lanes], found[:, language], len(sizes)).astype(np.int64)
        return counts

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Lanes come longest first, so those still running are a prefix."""
        state = np.repeat(self.starts[None, :], len(start), 0).astype(np.int64)
        count = np.ones(state.shape, np.int32)
        running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for step in range(int(length[0])):
            n = int(running[step])
            symbol = symbols[start[:n] + step]
            after = self._way(state[:n], symbol)
            ended = after < 0
            count[:n] += ended
            state[:n] = np.where(ended, self._way(np.broadcast_to(self.starts, ended.shape), symbol), after)
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, sizes = letters(texts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        has_letter = np.bincount(owner, codes > 0, len(sizes)) > 0
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        counts = self.phrases(codes, sizes)
        best = counts.argmin(1)
        fewest = counts.min(1)
        if len(self.names) > 1:
            second = np.partition(counts, 1, axis=1)[:, 1]
            score = 1 - fewest / np.maximum(second, 1)
        else:
            score = np.ones(len(texts))
        names = [self.names[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)]
        return names, np.clip(np.where(has_letter, score, 0.0), 0.0, 1.0)


def _evenly(codes: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """``most`` codes at most, the same number of the first ones of each text; what short
    texts leave goes to the others."""
    if len(codes) <= most:
        return codes
    order = np.sort(sizes)
    shares = (most - (np.cumsum(order) - order)) // np.arange(len(order), 0, -1)
    share = shares[np.argmax(order > shares)]
    return codes[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < share]


def _unknown(alphabet: np.ndarray) -> int:
    """The symbol of code points that no sample has; it is never among the table's columns."""
    return max(len(alphabet), SYMBOLS - 1) + 1


def build(samples: dict[str, list[str]], letters_each: int = LETTERS, letters_all: int = ALL_LETTERS) -> Languages:
    """``samples``: texts of each language. The most frequent code points are columns of the
    table, the others have keys. A code point that a language's text lacks leads from the
    start to a state without a way on, and so is a phrase of its own."""
    names = sorted(samples)
    each = min(letters_each, letters_all // max(len(names), 1))
    parts = [_evenly(*letters(samples[name]), each) for name in names]
    everything = np.concatenate([np.zeros(1, np.uint32), *parts])
    alphabet, times = np.unique(everything, return_counts=True)
    symbols = np.zeros(len(alphabet), np.int64)
    # The blank is 0, the rest follow by frequency; the table's last column has no symbol alone.
    rank = np.argsort(-times[1:], kind="stable")
    symbols[1:][rank] = np.arange(1, len(alphabet))
    unknown = _unknown(alphabet)
    tables, keys, ways, starts, offset = [], [], [], [], 0
    for part in parts:
        states = suffix_automaton(symbols[np.searchsorted(alphabet, part)])
        flat = np.array([(at, symbol, to) for at, state in enumerate(states) for symbol, to in state.items()], np.int64).reshape(-1, 3)
        own = np.full((len(states) + 1, SYMBOLS), -1, np.int32)
        own[0] = len(states) + offset
        common = flat[flat[:, 1] < SYMBOLS - 1]
        own[common[:, 0], common[:, 1]] = common[:, 2] + offset
        rare = flat[flat[:, 1] >= SYMBOLS - 1]
        keys.append((rare[:, 0] + offset) * unknown + rare[:, 1])
        ways.append((rare[:, 2] + offset).astype(np.int32))
        tables.append(own)
        starts.append(offset)
        offset += len(own)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    order = np.argsort(key)
    return Languages(names, alphabet, symbols, np.concatenate(tables) if tables else np.zeros((1, SYMBOLS), np.int32),
                     key[order], (np.concatenate(ways) if ways else np.zeros(0, np.int32))[order], np.array(starts, np.int64))


def fit(docs: DataFrame, texts: int = TEXTS, letters_each: int = LETTERS) -> Languages:
    """Learns from rows with an id and a language that are not held out, from a part of each
    text that starts at a hashed place. The rows with the
    lowest hashes are picked in every task before the shuffle, so a language that has most
    rows does not meet in one task."""
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    part = 4 * letters_each // texts
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - part, F.lit(0)) + 1) + 1
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)) \
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.substring("text", start.cast("int"), F.lit(part)).alias("text")) \
        .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= texts).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.nth)):
        samples.setdefault(row.lang, []).append(row.text)
    return build(samples, letters_each)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                                          names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_pieces(predicted, "text"), "doc_id long, held_out boolean, lang_pred string, score double")
