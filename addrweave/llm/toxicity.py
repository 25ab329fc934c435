"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its distinct words, neighbouring word pairs and pairs
with one word between them (skip-grams), each hashed to one of ``2**bits``
slots.  Training visits a bounded sample of labelled rows with per-coordinate
learning rates and an L1 term that keeps most weights at exactly zero, so what
is broadcast is a short list of slots and weights (never more than the slots).
Scoring is one pass over the texts without a shuffle.

Nulls: a null text counts as empty and gets the score of the bias alone; rows
with a null label or id are not learned from.  Repeated labels of one id count
once, as the largest; of different texts under one id the least is learned from.
Every row is scored by its own text.  Empty tables give a model without weights,
that is 0.5.  The model is trained when the function is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import documents, per_block, remainder

BITS = 20
MAX_TRAINING_ROWS = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 0.0
POSITIVE_WEIGHT = 2.0

_SKIP = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xA0761D6478BD642F)


def slots(block: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every n-gram and skip-gram of a block's texts."""
    data, at = text.raw(block.column("text"))
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.ALNUM)
    words, rows = text.hashes(data, starts, ends), text.owners(first)
    found = [(rows, words)]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        if len(words) > gap:
            same = rows[:-gap] == rows[gap:]
            pair = text.mix(words[:-gap] * factor + words[gap:])
            found.append((rows[:-gap][same], pair[same]))
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found]) >> np.uint64(64 - bits)


def ftrl(examples: list[tuple[np.ndarray, float]], bits: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of FTRL-proximal over examples of (slots, label); the last slot is the bias.

    Returns the slots with a weight other than zero, and the weights.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1 * (at < size - 1), 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, label = examples[k]
            at = np.append(at, size - 1)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE_WEIGHT if label else 1)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w)
    return kept.astype(np.int64), w[kept]


def fit(labelled: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from (doc_id, text, label), at most MAX_TRAINING_ROWS rows.

    Rows are turned into slots where they lie; one task then runs FTRL over the
    bounded sample.
    """

    def features(block):
        rows, at = slots(block, bits)
        both = np.unique(rows.astype(np.int64) << bits | at.astype(np.int64))
        cuts = np.searchsorted(both >> bits, np.arange(block.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
        return pa.RecordBatch.from_arrays([block.column("doc_id"), lists, block.column("label")], ["doc_id", "slots", "label"])

    def train(batches):
        table = pa.Table.from_batches(batches).sort_by("doc_id") if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            column = table.column("slots").combine_chunks()
            cuts, values = column.offsets.to_numpy(), column.values.to_numpy()
            labels = table.column("label").to_numpy()
            kept, w = ftrl([(values[a:b], y) for a, b, y in zip(cuts[:-1], cuts[1:], labels, strict=True)], bits)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w)], ["slot", "weight"])

    made = per_block(labelled, features, "doc_id long, slots array<int>, label double")
    model = made.repartition(1).mapInArrow(train, "slot long, weight double").toPandas()
    return model["slot"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """A fixed pseudo-random choice of at most ``rows`` labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    known = known.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by ``rows``
    return documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many slots as L1 leaves, 2**bits at most
    made: list = []

    def dense():
        if not made:
            at, w = shared.value
            made.append(np.zeros((1 << bits) + 1, np.float32))
            made[0][at] = w
        return made[0][:-1], float(made[0][-1])

    def score(block):
        weights, bias = dense()
        rows, found = slots(block, bits)
        hit = weights[found] != 0
        both = np.unique(rows[hit].astype(np.int64) << bits | found[hit].astype(np.int64))
        total = bias + np.bincount(both >> bits, weights[both & ((1 << bits) - 1)], block.num_rows)
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], ["doc_id", "score"])

    return per_block(documents(docs), score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", divisor: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Score all documents by a model learned from the labels outside the held-out split.

    Returns doc_id, held_out, score and predicted (1 where score >= threshold).
    """
    learn = labels.where(remainder("doc_id", divisor) != held)
    scores = score_toxicity(docs, fit(sample(docs, learn, label_col)))
    return scores.select("doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
