"""Toxicity of documents: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs of words with one between them, hashed
to ``2 ** bits`` places. Training follows McMahan et al., "Ad click prediction: a view from the trenches": each place
has its own learning rate, and an L1 penalty keeps places at zero that have not shown enough. So the weights left are
few, at most ``2 ** bits`` by construction, and are broadcast.

Labels are learnt from at most ``fit_rows`` labelled documents that are not held out (those with the smallest hashes of
their ids; a documented bound), one after the other in one task, ``epochs`` times. Their features are worked out in
parallel. Scores cover every whole text and depend on nothing but the text.

Nulls: a null text is empty and scores what the intercept gives; a document without an id is never trained on. Labels
that are null or without a document are left out; repeated labels count each. Without labels every score is 0.5. Empty
tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm import shingles
from opsframe.llm.common import settle, ship

ship("opsframe.llm.shingles")
ship(__name__)

BITS = 20
FIT_ROWS = 16_384
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """The fold that is never trained on; rows without an id are in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def places(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of all features of one text's word hashes, with repeats."""
    one = np.uint64(0x9E3779B97F4A7C15)
    two = np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        parts = [
            words,
            words[:-1] * one + words[1:] * two,
            words[:-2] * two + words[2:] * one + np.uint64(7),
        ]
        return (shingles.mix(np.concatenate(parts)) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """State of the proximal algorithm; place ``size`` is the intercept, which is not penalised."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.size = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == self.size
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        held = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, held / ((self.beta + np.sqrt(self.n[at])) / self.alpha + l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, self.size)
        w = self.weights(at)
        slope = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        before = self.n[at]
        self.n[at] = before + slope * slope
        self.z[at] += slope - (np.sqrt(self.n[at]) - np.sqrt(before)) / self.alpha * w


def train(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 3, bits: int = BITS, **options
) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, their weights, and the intercept."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.select(F.xxhash64("doc_id").alias("turn"), F.col("toxic").cast("int").alias("toxic"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = shingles.words(batch.column(2))
            ends = np.cumsum(counts)
            own = [np.unique(places(hashes[e - n : e], bits)).astype("<u4").tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["turn", "toxic", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = (
            (int(label.as_py() > 0), np.frombuffer(own.as_py(), "<u4").astype(np.int64))
            for batch in batches
            for label, own in zip(batch.column(1), batch.column(2), strict=True)
        )
        rows = list(islice(labelled, fit_rows))  # rows that repeat an id are bounded too
        state = Ftrl(1 << bits, **options)
        for _ in range(epochs):
            for label, own in rows:
                state.learn(own, label)
        every = np.arange(state.size + 1)
        w = state.weights(every)
        at = every[w != 0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["place", "weight"])

    extracted = settle(found.mapInArrow(extract, "turn bigint, toxic int, places binary"), "features")
    learnt = extracted.coalesce(1).sortWithinPartitions("turn", "toxic", "places").mapInArrow(learn, "place bigint, weight double")
    rows = learnt.toPandas().sort_values("place")
    at, weight = rows["place"].to_numpy(np.int64), rows["weight"].to_numpy(float)
    base = at == 1 << bits
    return at[~base], weight[~base], float(weight[base].sum())


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, base = shared.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = weight
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                hashes, counts = shingles.words(part.column(1))
                sums = np.full(len(part), base)
                end = 0
                for k, n in enumerate(counts.tolist()):
                    end += n
                    if n:
                        own = places(hashes[end - n : end], bits)
                        sums[k] += table[np.unique(own[table[own] != 0])].sum(dtype=float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
