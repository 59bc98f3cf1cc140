"""Quality classifier: hashed word n-gram logistic regression by follow-the-regularised-leader, scored as sparse dots.

A word has two views: its letters and digits, and its shape (case, the symbols around it, whether it repeats the word
before). The features are hashed unigrams and bigrams of both views, counted and scaled to unit length. Weights follow
the per-coordinate FTRL-proximal update over at most ``SAMPLE_DOCS`` labelled texts in hash order, ``EPOCHS`` times.

Null or empty text: scored by the bias alone. Very long text: all of its features, in training and scoring. One class only
or no labels: the bias decides, 0.5 without labels. Repeated label rows: one, with the higher label. Repeated ids: one of
their texts is learned from, the one with the smallest hash. Ties and repeated rows: each row is scored for itself. Columns
not asked for are never read; one named like the output gives way. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, tidy
from .vectext import Words, blocks, mix

#: Labelled texts used for training, chosen by hash (the bound of the classifier's sample), and passes over them.
SAMPLE_DOCS = 6_000
EPOCHS = 2
#: Weights: 2 to this power.
BITS = 18

_WORDY = np.array([chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a run of texts: (text, feature, value), values of a text have unit length."""
    w = Words(texts)
    n = len(w.doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    core = w.hashes(_WORDY)
    byte = w.raw[w.byte_at]
    wordy = _WORDY[byte]
    symbol = mix(w.sums(np.where(wordy, 0, byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    upper, letters = w.sums(_UPPER[byte].astype(np.int64)), w.sums(wordy.astype(np.int64))
    shout = (upper >= 2) & (upper * 2 > letters)
    again = np.zeros(n, bool)
    again[1:] = (core[1:] == core[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = mix(symbol + shout.astype(np.uint64) * np.uint64(7) + again.astype(np.uint64) * np.uint64(77) + (letters == 0).astype(np.uint64) * np.uint64(777) + (upper > 0).astype(np.uint64) * np.uint64(7777))
    pair = w.doc[1:] == w.doc[:-1]
    hashes, docs = [], []
    for salt, view in ((1, core), (2, shape)):
        one = mix(view + np.uint64(salt))
        two = mix(view[:-1] * np.uint64(0xD1342543DE82EF95) + view[1:] + np.uint64(salt + 16))
        hashes += [one, two[pair]]
        docs += [w.doc, w.doc[1:][pair]]
    key = (np.concatenate(docs).astype(np.int64) << bits) | (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc, index = key >> bits, key & ((1 << bits) - 1)
    norm = np.sqrt(np.bincount(doc, weights=count.astype(float) ** 2, minlength=len(texts)))
    return doc, index, count / norm[doc]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, part in blocks(texts):
            doc, index, value = features(part)
            out[first : first + len(part)] += np.bincount(doc, weights=self.weights[index] * value, minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class Ftrl:
    """FTRL-proximal logistic regression, one example at a time; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias, self.alpha, self.beta, self.l1, self.l2 = np.array([1 << bits]), alpha, beta, l1, l2

    def weight(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, label: int, index: np.ndarray, value: np.ndarray) -> None:
        i, x = np.concatenate((index, self.bias)), np.concatenate((value, [1.0]))
        w = self.weight(i)
        p = 1 / (1 + np.exp(-np.clip((w * x).sum(), -40, 40)))
        g = (p - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g

    def model(self) -> Model:
        w = self.weight(np.arange(len(self.z)))
        return Model(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the texts that ``labels`` (id, label 0 or 1) marks; null texts count as empty, null labels are left out.

    The sample is drawn from the labels, so only its texts move. They are turned into features where they are; one task
    runs the updates over the bounded sample, each example as it is read: once for each epoch, sorted by epoch and hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(marked), "id")  # at most SAMPLE_DOCS rows
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text", F.xxhash64("id").alias("h"))

    def extract(frames):
        for f in frames:
            got = []
            for first, part in blocks(list(f["text"])):
                doc, index, value = features(part)
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                for d in range(len(part)):
                    i, v = index[edge[d] : edge[d + 1]], value[edge[d] : edge[d + 1]].astype(np.float32)
                    got.append((int(f["h"].iloc[first + d]), int(f["label"].iloc[first + d]), i.astype("<i4").tobytes(), v.tobytes()))
            yield pd.DataFrame(got, columns=["h", "label", "i", "v"])

    def learn(frames):
        state = Ftrl()
        for f in frames:
            for r in f.itertuples(index=False):
                state.update(r.label, np.frombuffer(r.i, "<i4"), np.frombuffer(r.v, "<f4").astype(float))
        model = state.model()
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    seen = rows.mapInPandas(tidy(extract), "h long, label int, i binary, v binary").select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "*")
    got = seen.repartition(1).sortWithinPartitions("epoch", "h", "label", "i").mapInPandas(tidy(learn), "weights binary, bias double").collect()
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """Columns ``keep`` with the probability of label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats
    keep = [c for c in keep if c.lower() != out.lower()]
    held = free_name("__text", keep)
    schema = docs.select(*keep).schema.add(out, "double")

    def judge(frames):
        m = shared.value
        for f in frames:
            result = f.drop(columns=held)
            result[out] = m.score(list(f[held]))
            yield result

    return docs.select(*keep, F.col(text).alias(held)).mapInPandas(tidy(judge), schema)
