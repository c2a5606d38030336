"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-case words, of pairs of neighbours and of
pairs with one word between them. FTRL-proximal gives every coordinate a rate of its own and, by its
L1 term, leaves the weights of features without evidence at exactly zero; the few others, as (index,
weight) pairs, are all that is sent to the executors. Features aren't scaled by a text's length: a few
insults in a very long text count as much as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, labelled, shared

#: Features are hashed to so many bits.
BITS = 24
SEEDS = np.array([0x51ED270B9F652295, 0xA24BAED4963EE407], np.uint64)


@dataclass(frozen=True)
class Params:
    """Of FTRL: rates alpha and beta, L1 and L2, weight of toxic examples, passes over the sample,
    and the number of the sample's documents in which a feature must stand to be learned."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    toxic_weight: float = 2.0
    epochs: int = 3
    least_documents: int = 3
    most_labelled: int = labelled.MAX_LABELLED


def features(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of each feature, in no order and with repeats."""
    offsets, data = arrays.buffers(arrays.strings(pc.utf8_lower(column)))
    starts, ends = arrays.runs(arrays.WORD[data], offsets)
    row, word = arrays.row_of(starts, offsets), arrays.hash_spans(data, starts, ends)
    rows, hashes = [row], [word]
    with np.errstate(over="ignore"):
        for gap, seed in zip((1, 2), SEEDS, strict=True):
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            hashes.append(arrays.mix(word[:-gap][same] * seed + word[gap:][same]))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """The learner; the last coordinate is the bias, free of L1."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self.z = np.zeros((1 << BITS) + 1, np.float32)
        self.n = np.zeros((1 << BITS) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at].astype(np.float64), self.n[at].astype(np.float64)
        l1 = np.where(at == 1 << BITS, 0.0, self.p.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.p.beta + np.sqrt(n)) / self.p.alpha + self.p.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (self.p.toxic_weight if y else 1.0)
        n = self.n[at].astype(np.float64)
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > self.p.l1)
        at = np.union1d(at, [1 << BITS])
        return at, self.weights(at)


def fit(sample: DataFrame, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) that aren't zero, the bias last. Only these reach the driver.

    One task learns, in the order of the ids' hashes, so that the model doesn't depend on how the
    rows arrive.
    """

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            order, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = 0
            for s in arrays.slices(arrays.strings(batch.column(2))):
                row, at = features(s)
                key = np.unique(row << 32 | at)
                bounds = np.searchsorted(key, np.arange(len(s) + 1) << 32)
                at = (key & 0xFFFFFFFF).astype(np.uint32)
                seen += [(order[done + k], int(label[done + k]), at[bounds[k] : bounds[k + 1]]) for k in range(len(s))]
                done += len(s)
        seen.sort(key=lambda x: (x[0], x[1], x[2].tobytes()[:64]))
        documents = np.zeros(1 << BITS, np.int32)
        for _, _, at in seen:
            documents[at] += 1
        seen = [(order, label, at[documents[at] >= p.least_documents]) for order, label, at in seen]
        learner = Ftrl(p)
        for _ in range(p.epochs):
            for _, label, at in seen:
                learner.learn(np.append(at.astype(np.int64), 1 << BITS), label)
        at, w = learner.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    rows = sample.select("order", "label", "text").repartition(1).mapInArrow(learned, "at long, w double").toPandas()
    rows = rows.sort_values("at")
    return rows["at"].to_numpy(np.int64), rows["w"].to_numpy(np.float64)


def score_slice(column: pa.StringArray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The logit of each text."""
    row, index = features(column)
    some = np.zeros(1 << BITS, bool) if len(index) > 200_000 else None
    if some is not None:  # most features have no weight
        some[at[:-1]] = True
        hit = some[index]
        row, index = row[hit], index[hit]
    key = np.unique(row << 32 | index)
    row, index = key >> 32, key & 0xFFFFFFFF
    place = np.minimum(np.searchsorted(at, index), len(at) - 1)
    value = np.where(at[place] == index, w[place], 0.0)
    return np.bincount(row, weights=value, minlength=len(column)) + w[-1]


def toxicity(text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """The probability that a text is toxic; null for null."""
    at, w = model
    if not len(at):
        at, w = np.array([1 << BITS]), np.zeros(1)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        texts = arrays.strings(texts)
        logits = np.concatenate([score_slice(s, at, w) for s in arrays.slices(texts)] or [np.zeros(0)])
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return scored(text)


def detect(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, toxicity, is_toxic) of every row of docs, by a model fitted on labelled documents.

    Toxic is what scores above the threshold. Null text: null score, not toxic. Empty text: the
    bias alone. Null ids and repeated rows are scored row by row. With no labels every score is 0.5
    and nothing is toxic. Other columns don't matter, whatever their names.
    """
    model = fit(labelled.sample(docs, labels, label_col, p.most_labelled, id_col, text_col), p)
    scored = docs.select(shared.named(id_col).alias(id_col), toxicity(shared.named(text_col), model).alias("toxicity"))
    return scored.select(id_col, "toxicity", F.coalesce(F.col("toxicity") > threshold, F.lit(False)).alias("is_toxic"))
