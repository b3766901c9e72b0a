"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (blanks become the mark, one is put in front) and cut into marked words:
a run of marks with what follows. No piece of a vocabulary that is split at white space
crosses such a cut, and none holds a character that no longer piece uses, so the best
segmentation of a text is that of its words one after another.

The different words of a slice of documents are sorted, which lays them out as the
depth-first traversal of their trie. A word takes over the best scores of the prefix that
it shares with the one before it and goes on from there. Words are kept from slice to
slice as long as they are few enough.

The model is read for its pieces and scores; a segmentation maximises the sum of scores
(the unigram rule; of equal ones, that with the longest last piece). Characters without a piece score ten below the lowest piece and
are written as bytes. Decoding joins pieces and bytes, turns marks to blanks and drops
the first.

Defined cases: null text encodes to null, empty text to no ids, and both decode to
themselves; ids outside the vocabulary raise; bytes that are no UTF-8 decode to U+FFFD;
a text that holds the mark itself decodes with blanks in its place, as in the library;
repeated rows repeat; extra columns are ignored or kept by ``with_ids``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmend.llm.common import by_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in a model file, and how far below all an unknown scores.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Different words that a worker remembers, some 700 bytes each while they are learned.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores. Bounded by the model, so it is broadcast."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: tuple[int, ...]
    texts: list[bytes | None]
    endings: dict[str, float] = field(default_factory=dict)
    unknown: float = 0.0
    cut: str = ""

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]]) -> Vocabulary:
        usable = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in usable):
            raise ValueError("a piece crosses white space: texts cannot be cut into words")
        by_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(by_byte) < 256:
            raise ValueError("the model has no pieces for bytes")
        texts: list[bytes | None] = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b""
            for p, _, kind in pieces]
        joined = {c for p in usable if len(p) > 1 for c in p}
        alone = [c for c in "\n\t\r" if c not in joined]
        cut = f"{MARK}*[^{MARK}{''.join(alone)}]+|{MARK}+" + (f"|[{''.join(alone)}]" if alone else "")
        scores = {p: s for p, (_, s) in usable.items()}
        endings = {p[at:]: -math.inf for p in usable for at in range(1, len(p))} | scores
        return cls({p: i for p, (i, _) in usable.items()}, scores, tuple(by_byte[b] for b in range(256)), texts, endings,
                   min((s for _, s in usable.values()), default=0.0) - UNKNOWN_PENALTY, cut)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces \
                or model.normalizer_spec.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts in a way that is not supported")
        return cls.of([(p.piece, p.score, p.type) for p in model.pieces])

    def words(self, text: str) -> list[str]:
        return re.findall(self.cut, MARK + text.replace(" ", MARK)) if text else []

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of ``words``, which are sorted."""
        scores, ids, unknown, find = self.scores, self.ids, self.unknown, self.endings.get
        best, came = [0.0], [0]  # of the prefix that ends at a place: score, start of its last piece
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], came[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                # Pieces that end here, the shortest first, as long as a piece ends so at all.
                start = origin = end - 1
                piece = word[start:end]
                top = -math.inf if piece in scores else best[start] + unknown
                while (score := find(piece)) is not None:
                    if (score := score + best[start]) >= top:
                        top, origin = score, start
                    if not start:
                        break
                    start -= 1
                    piece = word[start:end]
                best.append(top)
                came.append(origin)
            out: list[int] = []
            end = len(word)
            while end:
                start = came[end]
                piece = word[start:end]
                if piece in ids:
                    out.append(ids[piece])
                else:
                    out.extend(self.bytes_[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
                end = start
            out.reverse()
            before = word
            yield out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        whole = b"".join(self.texts[i] for i in ids).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


@dataclass
class Encoder:
    """Encodes slices of texts, with the words seen lately."""

    vocabulary: Vocabulary
    remembered: int = REMEMBERED
    number: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        flat: list[int] = []
        sizes = []
        for found in self.vocabulary.segment(words):
            flat += found
            sizes.append(len(found))
        used = int(self.ends[-1]) if len(self.ends) else 0
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.ids = np.concatenate([self.ids, np.array(flat, np.int32)])
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        if len(self.number) > self.remembered:
            self.number, self.ids, self.ends = {}, self.ids[:0], self.ends[:0]
        words = [self.vocabulary.words(t or "") for t in texts]
        different = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        names = different.dictionary.to_pylist()
        self._learn(sorted(w for w in names if w not in self.number))
        at = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))[different.indices.to_numpy()]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        sizes = self.ends[at] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        word_ends = np.cumsum([len(part) for part in words], dtype=np.int64)
        return self.ids[places], np.r_[0, ends][word_ends]


def _encoded(encoder: Encoder, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All ids, and offsets of each text's ids that are null where the text is."""
    ids, ends = encoder.encode(texts.to_pylist())
    return pa.array(ids), pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[np.asarray(texts.is_null()), False])


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in place of the text, and of a column that has the
    name of the ids. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c not in (text_col, ids_col)]
    made: list[Encoder] = []

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Encoder(shared.value))
        texts = batch.column(text_col)
        ids, offsets = _encoded(made[0], texts)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, ids)], names=[*kept, ids_col])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias(text_col))
    schema = rows.drop(text_col).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(by_pieces(encoded, text_col), schema)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``encode``, and from the ids of each row ``decoded_sha256``, the digest of the text
    that they decode to, and ``same``, whether it is the row's text. Null decodes to null."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    made = [ids_col, "n_ids", "decoded_sha256", "same"]
    kept = [c for c in docs.columns if c not in (text_col, *made)]
    encoders: list[Encoder] = []

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not encoders:
            encoders.append(Encoder(shared.value))
        texts = batch.column(text_col)
        ids, offsets = _encoded(encoders[0], texts)
        lists = pa.ListArray.from_arrays(offsets, ids)
        digests, same = [], []
        for row, text in zip(lists, texts.to_pylist()):  # one row's ids as Python numbers at a time
            back = shared.value.decode(row.values.to_numpy().tolist() if row.is_valid else None)
            digests.append(None if back is None else hashlib.sha256(back.encode()).hexdigest())
            same.append(back == text)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), lists, pc.list_value_length(lists), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
            names=[*kept, *made])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias(text_col))
    schema = rows.drop(text_col).schema.add(ids_col, T.ArrayType(T.IntegerType())).add("n_ids", "integer").add("decoded_sha256", "string").add("same", "boolean")
    return rows.mapInArrow(by_pieces(both, text_col), schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids in place of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in rows.columns if c != ids_col]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [shared.value.decode(ids) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    return rows.mapInArrow(decoded, rows.drop(ids_col).schema.add(text_col, "string"))
