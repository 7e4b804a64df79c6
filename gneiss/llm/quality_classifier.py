"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.llm.session import small_batches
from gneiss.llm.words import mix, shingles, slices, words

#: Hash space of each of the four feature groups: words, word shapes, and pairs of each; pairs of shapes tell
#: whether both words are the same.
SPACE = 1 << 16
GROUPS = 4
#: The labelled rows that the model is fitted on at most: those with the lowest hashes of their ids.
TRAIN_ROWS = 3000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.002, 0.01
THRESHOLD = 0.3


def features(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Ranges of texts with, of each feature group, the feature of each word or pair and where each text's begin."""
    for lo, hi in slices(column):
        found = words(column.slice(lo, hi - lo))
        groups, plain = [], found.hashes()
        same, _ = shingles(found, np.append(plain[1:] == plain[:-1], False).astype(np.uint64)[: len(plain)], 1)
        for k, hashed in enumerate((plain, found.shapes())):
            pairs, first = shingles(found, hashed, 2)
            if k:
                at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], np.diff(first))
                pairs = pairs ^ same[at]
            for g, (own, at) in enumerate(((hashed, found.first), (pairs, first))):
                groups.append(((mix(own) % np.uint64(SPACE)).astype(np.int64) + (2 * k + g) * SPACE, at))
        yield lo, hi, groups


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of the weights with each text's features, whose values are their shares of their group."""
    out = np.full(len(column), weights[-1], np.float64)
    for lo, hi, groups in features(column):
        for feature, at in groups:
            total = np.concatenate((np.zeros(1), np.cumsum(weights[feature])))
            count = np.diff(at)
            out[lo:hi] += (total[at[1:]] - total[at[:-1]]) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """FTRL-proximal over rows (features, values, label) in a fixed shuffled order; the last weight is the bias."""
    size = GROUPS * SPACE + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    fit = np.abs(z) > L1
    w[fit] = -(z[fit] - np.sign(z[fit]) * L1) / ((BETA + np.sqrt(n[fit])) / ALPHA + L2)
    return w


def sparse_rows(column: pa.Array, labels: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    for lo, hi, groups in features(column):
        for t in range(hi - lo):
            at, x = [np.array([GROUPS * SPACE])], [np.ones(1)]
            for feature, first in groups:
                own, count = np.unique(feature[first[t] : first[t + 1]], return_counts=True)
                at.append(own)
                x.append(count / max(1, count.sum()))
            yield np.concatenate(at), np.concatenate(x), float(labels[lo + t])


def held_out(key: Column) -> Column:
    """Never used in training: ids whose CRC-32, as text, is divisible by 5, and null ids."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, fitted on at most rows labelled documents that aren't held out, with the lowest hashes of their ids.

    Labels are averaged by id (half counts as 1); null ids and labels are left out. Without any, all weights are 0.
    Rows of docs that repeat an id all have its label. One task reads the bounded sample and fits the model.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    known = known.orderBy(order, "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `rows` ids
    sample = sample.orderBy(order, "doc_id", F.xxhash64("text")).limit(rows).select("text", "y")

    def fitted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [row for batch in found for row in sparse_rows(batch.column(0), batch.column(1).to_pylist())]
        if own:
            w = train(own)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f4").tobytes()])], ["at", "w"])

    weights = np.zeros(GROUPS * SPACE + 1, np.float32)
    for row in sample.coalesce(1).mapInArrow(fitted, "at binary, w binary").collect():
        weights[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["w"], "<f4")
    return weights


def with_scores(docs: DataFrame, weights: np.ndarray, name: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each whole text, 0 to 1. All rows and columns stay; a null text is an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size: GROUPS * SPACE + 1 floats
    at = docs.columns.index(text)
    schema = docs.limit(0).withColumn(name, F.lit(0.0)).schema

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), shared.value))], [*batch.schema.names, name])

    return docs.mapInArrow(batches, schema)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; repeated rows have equal scores."""
    weights = fit(docs, labels, rows)
    scored = with_scores(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
