"""Word shingles of texts as sorted sets of 64-bit hashes, by arrays of bytes.

A-Z are lower-cased; words are runs of bytes other than white space; a shingle is a run of
``width`` words, or all words where there are fewer. A word's hash is a polynomial over
random numbers for its bytes, so all words of a slice come from two running products; a
shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random odd number for each byte, and whether it is white space. Capitals share
    the number of their small letter."""
    value = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    value[ord("A"):ord("Z") + 1] = value[ord("a"):ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return value, space


@cache
def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count, base, np.uint64)])


def _segment_hashes(data: np.ndarray) -> np.ndarray:
    value, space = _tables()
    blank = space[data]
    inside = np.r_[False, ~blank, False]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    count = max(_SEGMENT, 1 << (len(data) - 1).bit_length())
    running = np.r_[np.uint64(0), np.cumsum(value[data] * _powers(_BASE, count)[:len(data)])]
    return mixed((running[ends] - running[starts]) * _powers(_INVERSE, count)[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of a text, in order. Long texts go in segments that end at
    white space, so arrays stay small whatever the text's length."""
    if len(raw) <= _SEGMENT:
        return _segment_hashes(np.frombuffer(raw, np.uint8))
    data = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero(_tables()[1][data])
    parts, start = [], 0
    while start < len(data):
        end = len(data)
        if start + _SEGMENT < end:
            at = np.searchsorted(cuts, start + _SEGMENT)  # the first white space from there on
            end = int(cuts[at]) if at < len(cuts) else end
        parts.append(_segment_hashes(data[start:end]))
        start = max(end, start + 1)
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted different shingles of a text's words."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    count = len(words) - width_here + 1
    total = np.zeros(count, np.uint64)
    for i in range(width_here):
        total = mixed(total + words[i:i + count]) + np.uint64(i + 1)
    return np.unique(total + np.uint64(width_here == width))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text. Short texts are hashed together, parted by white space."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) > _SEGMENT // 2 and group:
            yield from _grouped(group, width)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _grouped(group, width)


def _grouped(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    if len(raws) == 1:
        yield shingle_set(word_hashes(raws[0]), width)
        return
    joined = b"\n".join(raws)
    data = np.frombuffer(joined, np.uint8)
    blank = _tables()[1][data]
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    text_ends = np.cumsum([len(r) + 1 for r in raws])
    per_text = np.searchsorted(begins, text_ends)
    words = _segment_hashes(data)
    for start, end in zip(np.r_[0, per_text[:-1]], per_text):
        yield shingle_set(words[start:end], width)
