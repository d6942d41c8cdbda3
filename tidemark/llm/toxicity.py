"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, neighbouring pairs and pairs over one
word. The optimiser keeps a rate for each coordinate and sets weights below the L1
threshold to exactly zero, so the model is a short list that is safe to broadcast.
A feature's value is its rarity among the examples, which keeps common words from
drowning rare ones in long texts; it is folded into the weights afterwards.
Examples pass through one task in an order fixed by their ids; their number is
bounded by TRAIN_ROWS, and scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORDS, held_out, map_arrow, share, split, table

#: Labelled documents that the classifier is fitted on at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 1 << 14
#: Bits of the feature space; rate, smoothing and threshold of the optimiser; passes over the examples.
BITS, ALPHA, BETA, L1, PASSES = 20, 2.0, 1.0, 3.0, 5
#: Scores from here on count as toxic.
THRESHOLD = 0.3


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a whole text; an empty one has none."""
    words = split(text, WORDS)
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
    pair = (h[:-1] * np.uint64(0x85EBCA77C2B2AE63)) ^ h[1:]
    skip = (h[:-2] * np.uint64(0xD6E8FEB86659FD93)) ^ h[2:]
    mixed = np.concatenate([h, pair, skip]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal; the bias has no threshold."""

    def __init__(self, rarity: np.ndarray):
        self.rarity = rarity
        self.z, self.n = np.zeros(len(rarity)), np.zeros(len(rarity))
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) * ALPHA / (BETA + np.sqrt(self.n[at])))

    def bias(self) -> float:
        return -self.bias_z * ALPHA / (BETA + self.bias_n**0.5)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b, x = self.weights(at), self.bias(), self.rarity[at]
        error = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - y
        g, n = error * x, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_z += error - ((self.bias_n + error * error) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += error * error


def packed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers in two bytes each: their lower halves, and how many there are of each upper half."""
    return at.astype(np.uint16), np.bincount(at >> 16).astype(np.int32)


def unpacked(low: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(per)) << 16, per) + low


def train(examples: Iterable[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers and weights that are not zero, and the bias. Without examples the bias rejects nothing."""
    rarity, held = np.zeros(2**bits), []
    for at, y in examples:
        rarity[at] += 1
        held.append((*packed(at), y))
    if not held:
        return np.empty(0, np.int64), np.empty(0), -35.0
    rarity += 1
    np.log(np.divide(len(held) + 1, rarity, out=rarity), out=rarity)
    rarity /= np.log(len(held) + 1)
    model = Ftrl(rarity)
    for _ in range(PASSES):
        for low, per, y in held:
            model.learn(unpacked(low, per), y)
    kept = np.flatnonzero(np.abs(model.z) > L1)
    w = model.weights(kept) * rarity[kept]
    return kept[w != 0], w[w != 0], model.bias()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers and weights that are not zero, and the bias.

    labels: (doc_id, toxic), of which rows with a null are left out and a document
    counts as toxic if any of its labels says so. A model without examples has only
    a bias of -35, so that nothing is rejected.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.withColumn("_o", order).orderBy("_o", "doc_id").limit(rows)
    # At most `rows` labels of three numbers each.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("_o", "doc_id", "text")

    def run(batches) -> Iterator[dict]:
        at, w, bias = train((features(t), int(y)) for texts, toxic in batches for t, y in zip(texts, toxic, strict=True))
        yield {"at": [-1, *at.tolist()], "w": [bias, *w.tolist()]}

    got = map_arrow(texts.select("text", "toxic"), run, "at long, w double").collect()
    bias = next((r.w for r in got if r.at < 0), -35.0)
    kept = [r for r in got if r.at >= 0]
    return np.array([r.at for r in kept], np.int64), np.array([r.w for r in kept]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs plus score, from 0 to 1, of each whole text. Null texts score as empty ones do."""
    held = share(docs.sparkSession, model)

    def run(batches) -> Iterator[dict]:
        at, w, bias = held()
        dense = np.zeros(2**BITS)
        dense[at] = w
        for cols in batches:
            sums = np.array([dense[features(t)].sum() + bias for t in cols[-1]])
            yield dict(zip(keep, cols, strict=False)) | {"score": 1 / (1 + np.exp(-np.clip(sums, -35, 35)))}

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return map_arrow(docs.select(*keep, F.col("text").alias("_text")), run, ", ".join([*kinds, "score double"]))


def train_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out quarter."""
    return labels.where(~held_out("doc_id", 4, 2)).select("doc_id", "toxic")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every document; learns from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, train_labels(table(spark, sf_dir, "labels")))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
