"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are words and pairs of neighbouring words, each as written and by its
shape (letter case, digits, marks), hashed into a fixed number of weights, and
marks for words and pairs that the text has had before. A feature's value is
its share of the text's features. A score is the sparse dot product of values
and weights, through the logistic function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

#: Weights: 2**BITS.
BITS = 18
#: At most about so many labelled rows are learnt from, picked by a hash of their id.
SAMPLE = 24_000
#: Learners whose weights are averaged; each takes its share of the sample.
SHARDS = 4
EPOCHS = 4
MEMO = 250_000

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_RUN = regex.compile(r"(\p{Lu})+|(\p{L})+|(\p{N})+|(.)", regex.S)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _shape(word: str) -> str:
    """Runs of upper case as X, of other letters as x, of digits as 9; other characters as they are, at most three of a kind in a row."""
    if word.isalpha():  # the usual cases, by the same rule
        if word.islower():
            return "x"
        if word[0].isupper() and (len(word) == 1 or word[1:].islower()):
            return "Xx" if len(word) > 1 else "X"
    out = "".join(["X" if m[1] else "x" if m[2] else "9" if m[3] else m[0] for m in _RUN.finditer(word)])
    return regex.sub(r"(.)\1{3,}", r"\1\1\1", out)


class _Words(dict):
    """Word -> row of ``hashes`` (word, shape); words are added as they come."""

    def __init__(self):
        self.hashes, self.shapes = np.zeros((1 << 16, 2), np.uint64), {}

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        ends = word[-1] in ",." and len(word) > 1
        shape = _shape(word[:-1]) + word[-1] if ends else _shape(word)
        if (known := self.shapes.get(shape)) is None:
            known = self.shapes[shape] = _hash("shape " + shape)
        self.hashes[i] = _hash(word), known
        self[word] = i
        return i


class Featurizer:
    """Texts to (index, value) arrays; indices rise and are unique."""

    def __init__(self, bits: int = BITS):
        self.bits, self._words = bits, _Words()

    def hashes(self, text: str) -> np.ndarray:
        """Hashed features of a text with repeats, marks for repetition last."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self._words) >= MEMO:
            self._words = _Words()
        row = np.fromiter(map(self._words.__getitem__, words), np.int64, len(words))
        word, shape = self._words.hashes[row].T
        pair = _mix(word[:-1] * _M1 + word[1:] * _M3)
        shift = np.uint64(64 - self.bits)
        n_new, n_pairs = len(np.unique(word)), len(np.unique(pair))
        marks = np.concatenate([np.full(len(word) - n_new, _hash("word again")), np.full(len(pair) - n_pairs, _hash("pair again")), np.full(int((word[:-1] == word[1:]).sum()), _hash("same word"))]).astype(np.uint64)
        every = np.concatenate([_mix(word), pair, _mix(shape * _M4), _mix(shape[:-1] * _M3 + shape[1:] * _M4), _mix(marks)])
        return (every >> shift).astype(np.int64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.hashes(text)
        index, count = np.unique(found, return_counts=True)
        return index, SCALE * count / max(1, len(found))


#: Values are shares of a text's features times this, so that one step moves weights of rare features enough.
SCALE = 8.0


class FtrlProximal:
    """Follow-the-regularised-leader logistic regression, one update for each row."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: float, weight: float = 1.0) -> float:
        i, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(i)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = weight * (p - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g
        return p


def fit(labelled: DataFrame, bits: int = BITS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2**bits and the bias last) from ``doc_id, text, label``.

    :param labelled: rows with a label of 0 or 1; others are left out.
        They must be a bounded sample (see ``training_rows``): their features,
        not their texts, are shuffled to ``shards`` learners.

    Every shard learns from its rows in an order set by hashes of their ids;
    the shards' weights are averaged, weighted by their rows. Without rows of
    both labels the weights are 0 (every score is 0.5).
    """
    spark = labelled.sparkSession
    rows = labelled.where("label IN (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("spot", F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(bits)
        for batch in batches:
            made = [make(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array([x[0].astype(np.int32) for x in made], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in made], pa.list_(pa.float32()))],
                names=["label", "spot", "index", "value"],
            )

    made = rows.mapInArrow(features, "label int, spot long, index array<int>, value array<float>")
    made = made.repartitionById(shards, F.pmod("spot", F.lit(shards)).cast("int")).sortWithinPartitions("spot", "label")
    size = 1 << bits

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(i, v, float(y)) for batch in batches for y, i, v in zip(batch["label"], batch["index"], batch["value"])]
        if not own:
            return
        model = FtrlProximal(size)
        for _ in range(epochs):
            for i, v, y in own:
                model.update(i, v.astype(np.float64), y)
        w = model.weights(slice(None))
        some = np.flatnonzero(w)
        # Below 0: rows learnt from, and those of them with label 1.
        yield pd.DataFrame({"index": np.append(some, [-1, -2]), "weighted": np.append(w[some] * len(own), [len(own), sum(y for _, _, y in own)])})

    learnt = made.mapInPandas(learn, "index long, weighted double").groupBy("index").agg(F.sum("weighted").alias("weighted"))
    found = {r["index"]: r["weighted"] for r in learnt.collect()}  # as many rows as there are weights, at most 2**bits + 3
    n, ones = found.pop(-1, 0.0), found.pop(-2, 0.0)
    out = np.zeros(size + 1)
    if 0 < ones < n:
        out[list(found)] = np.array(list(found.values())) / n
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every whole text: a sparse dot product for each; a null text is the empty one, whose score is the bias's."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))
    bits = int(len(weights) - 1).bit_length() - 1
    source = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = Featurizer(bits), shared.value
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                found = make.hashes(x)
                dot = w[-1] + (SCALE * w[found].mean() if len(found) else 0.0)
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(dot))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, label`` of labelled documents that aren't held out; a hash of the id keeps about nineteen twentieths of ``sample`` of them, which many labels can't exceed. The labels kept are broadcast, so no text is shuffled."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * 0.95 * sample / total))
    known = known.withColumnRenamed("doc_id", "labelled")
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "label")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    :param docs: ``doc_id, text`` (others, ``lang`` and ``source`` among them, are never read).
    :param labels: ``doc_id, quality``; rows whose crc32 of the id modulo 4 is 2 are held out.

    Repeated rows get equal scores; a null ``doc_id`` isn't held out; an empty
    table gives an empty one; without labels every score is 0.5.
    """
    weights = fit(training_rows(docs, labels, sample))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
