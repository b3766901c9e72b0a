"""Quality by a vote of nearest labelled neighbours in a latent-semantic space.

Features are counts of pairs of neighbouring character classes, whatever the language:
they show symbols, capitals, tables and repetition. The fit takes a bounded sample of
labelled rows (``SAMPLE`` a label, those with the lowest hash of their id), weights
counts by log and inverse document frequency of the sample, and keeps the leading
singular directions. The sample's vectors are broadcast (at most ``2 * SAMPLE`` x
``DIRECTIONS`` floats, whatever the corpus); every document's cosine with every one of
them is computed in blocks, and its ``NEIGHBOURS`` nearest vote, weighted by similarity.

Defined cases: null text counts as empty; a text without any pair (none or one
character) and a corpus without usable labels score the sample's share of label 1, or
0.5 without a sample. Labels that are null, not 0 or 1, given to held-out documents, or
contradicting one another for a document are not used. Rows repeated give repeated rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmend.llm.common import by_pieces, held_out

SAMPLE = 1024
DIRECTIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
CLASSES = 64
_SLICE = (1 << 20, 4096)  # bytes of text, and for each row, counted together


def _byte_classes() -> np.ndarray:
    """A class for each byte of UTF-8: lower-case letters one each, capitals, digits and
    the bytes beyond ASCII one for all, marks one each as far as classes go."""
    of = np.full(256, 2, np.uint8)
    of[:32] = 1
    of[128:] = 3
    for i, letter in enumerate(string.ascii_lowercase):
        of[ord(letter)] = 4 + i
    for letter in string.ascii_uppercase:
        of[ord(letter)] = 30
    for digit in string.digits:
        of[ord(digit)] = 31
    for i, mark in enumerate(" \n\t" + string.punctuation):
        of[ord(mark)] = min(32 + i, CLASSES - 1)
    return of


_CLASS = _byte_classes()


def pair_counts(texts: pa.Array) -> np.ndarray:
    """For each text, how often each pair of classes stands side by side. Class 0, which no
    byte has, leaves room for repetition: of the words and of the lines, the share that
    repeats the one before, in tenths from 0.1 on, marked with twenty times the count of
    all pairs, since one such mark must weigh as much as many pairs."""
    filled = [t or "" for t in texts.to_pylist()]
    raw = [t.encode() for t in filled]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    classes = _CLASS[data].astype(np.int64)
    classes[ends - 1] = 0
    doc = np.repeat(np.arange(len(raw)), np.diff(np.r_[0, ends]))
    first, second = classes[:-1], classes[1:]
    inside = (first > 0) & (second > 0)
    key = doc[:-1][inside] * CLASSES**2 + first[inside] * CLASSES + second[inside]
    counts = np.bincount(key, minlength=len(raw) * CLASSES**2).reshape(len(raw), CLASSES**2)
    total = counts.sum(1)
    for i, text in enumerate(filled):
        for at, parts in ((0, text.split()), (16, text.split("\n"))):
            repeated = 10 * sum(map(str.__eq__, parts, parts[1:])) // max(len(parts), 1)
            if repeated:
                counts[i, at + repeated] = 20 * total[i]
    return counts


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts[:, CLASSES:].sum(1, keepdims=True)
    rate = np.log1p(1000.0 * counts / np.maximum(total, 1)) * idf
    return (rate / np.maximum(np.linalg.norm(rate, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Neighbours:
    """The fitted sample. Its size is bounded by parameters."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        for start in range(0, len(counts), block):
            part = counts[start:start + block]
            space = _weighted(part, self.idf) @ self.basis
            norm = np.linalg.norm(space, axis=1)
            cosine = (space / np.maximum(norm, 1e-12)[:, None]) @ self.vectors.T
            k = min(self.k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-6) ** 8
            vote = (weight * self.labels[near]).sum(1) / weight.sum(1)
            usable = (part.sum(1) > 0) & (norm > 0)
            out[start:start + block] = np.where(usable, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, directions: int = DIRECTIONS, k: int = NEIGHBOURS) -> Neighbours:
    """Learns from at most ``sample`` documents of each label.

    The ids come from ``labels`` and are a bounded list, so they are broadcast to the one
    scan of the texts; its rows come back as the counts that are not 0. The driver holds two
    tables of ``2 * sample`` x 4096 numbers of four bytes at most.
    """
    agreed = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")) \
        .where("quality = most").select("doc_id", F.col("quality").cast("int").alias("quality"))
    have = docs.select("doc_id", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [agreed.where(F.col("quality") == q).join(have.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(sample) for q in (0, 1)]
    picked = have.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "quality", "text")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = pair_counts(batch.column("text")).astype(np.float32)
        places = [np.flatnonzero(c).astype(np.uint16) for c in counts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([p.tobytes() for p in places], pa.binary()),
             pa.array([c[p].tobytes() for c, p in zip(counts, places)], pa.binary())],
            names=["doc_id", "quality", "places", "counts"])

    rows = picked.mapInArrow(by_pieces(counted, "text", *_SLICE), "doc_id long, quality int, places binary, counts binary").collect()
    rows = sorted({r.doc_id: r for r in rows}.values(), key=lambda r: r.doc_id)  # rows repeated learn once
    width = CLASSES**2
    if len(rows) < 2 or len({r.quality for r in rows}) < 2:
        label = np.array([r.quality for r in rows[:1]], np.float64)
        return Neighbours(np.ones(width), np.zeros((width, 1), np.float32), np.zeros((len(label), 1), np.float32), label, k)
    quality = np.array([r.quality for r in rows], np.float64)
    matrix = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        matrix[i, np.frombuffer(r.places, np.uint16)] = np.frombuffer(r.counts, np.float32)
    idf = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(0))) + 1
    del rows
    for start in range(0, len(matrix), 128):  # in place, a few rows at a time
        matrix[start:start + 128] = _weighted(matrix[start:start + 128], idf)
    values, left = np.linalg.eigh(matrix @ matrix.T)
    top = np.argsort(-values)[:directions]
    top = top[values[top] > 1e-6]
    basis = (matrix.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
    space = matrix @ basis
    vectors = space / np.maximum(np.linalg.norm(space, axis=1, keepdims=True), 1e-12)
    return Neighbours(idf, basis, vectors.astype(np.float32), quality, k)


def classify(docs: DataFrame, model: Neighbours, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(pair_counts(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)],
                                          names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_pieces(scored, "text", *_SLICE), "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Neighbours, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, with all their columns. The
    score is a column of the scan, so nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(pair_counts(batch.column("text")))
        return batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(by_pieces(chosen, "text", *_SLICE), docs.schema)
