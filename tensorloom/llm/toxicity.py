"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import label_fold, table

#: Hashed features; labelled documents learnt from at most (the bound of the one task that learns).
DIMENSIONS, MAX_TRAIN = 1 << 20, 16384
#: Step, its offset, L1 and L2 penalties, passes over the labelled documents.
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 5.0, 0.1, 5
#: Added to the log odds: a toxic document that is missed counts as exp(SHIFT), 7.4, clean ones that are flagged.
SHIFT = 2.0
#: Labelled documents that a feature must occur in to be learnt.
LEAST_DOCS = 3
_WORD = re.compile(rb"[a-z0-9\x80-\xff']+")
#: (distance between the two words, multipliers of their hashes): bigrams, and skip-grams over one and two words.
_PAIRS = ((1, 0x9E3779B1, 0x85EBCA77), (2, 0xC2B2AE3D, 0x27D4EB2F), (3, 0x165667B1, 0x9E3779B1))


def features(text: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """Hashed words, pairs of neighbours and pairs with one or two words between, with repeats."""
    words = _WORD.findall(text.lower())
    for w in {*words}:
        if w not in cache:
            cache[w] = zlib.crc32(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(cache) > 500_000:
        cache.clear()
    found = [h * np.uint64(0x2545F491)]
    for d, a, b in _PAIRS:
        found.append(h[:-d] * np.uint64(a) + (h[d:] ^ np.uint64(d)) * np.uint64(b))
    every = np.concatenate(found)
    return (every ^ (every >> np.uint64(29))) & np.uint64(DIMENSIONS - 1)


def ftrl(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from (distinct features, label) in the order of learning."""
    common = np.zeros(DIMENSIONS, np.int64)
    for x, _ in rows:
        common[x] += 1
    rows = [(x[common[x] >= LEAST_DOCS], y) for x, y in rows]
    z, n, z0, n0 = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0

    def weights(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(PASSES):
        for x, y in rows:
            zi, ni = z[x], n[x]
            w, w0 = weights(zi, ni, L1), float(weights(z0, n0, 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            z0, n0 = z0 + g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0, n0 + g * g
    w = weights(z, n, L1)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(weights(z0, n0, 0.0))


def fit(docs: DataFrame, labels: DataFrame, train_rows, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Sparse weights learnt from at most ``max_train`` labelled ids, those of least hash, and as many rows of these, of least hash too."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & train_rows)
    known = known.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select(F.xxhash64("id", "text").alias("k"), "y", "text")

    def hashed(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in them:
            x = [np.unique(features(t.as_py() or b"", cache)).astype(np.int32).tobytes() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["k", "y", "x"])

    def learnt(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(np.frombuffer(x, np.int32), y) for batch in them for x, y in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
        if own:
            at, w, bias = ftrl(own)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([bias, *w], pa.float64())], names=["at", "w"])

    # The order of learning is by hash: one task, of a bounded sample.
    model = rows.mapInArrow(hashed, "k bigint, y double, x binary").orderBy("k", "y").limit(max_train).repartition(1).sortWithinPartitions("k", "y").mapInArrow(learnt, "at bigint, w double").toPandas()
    if model.empty:
        return None
    bias = model["at"] < 0
    return model["at"][~bias].to_numpy(), model["w"][~bias].to_numpy(), float(model["w"][bias].iloc[0])


def score(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, score double) for every row of ``docs``: how likely its label is 1, over its whole text, weighed by ``SHIFT``.

    ``train_rows``: a condition on the labels' ``id``; only such rows are learnt from, each id with the mean
    of its labels; null labels don't count. Null texts are empty; an empty text has the score of the bias and ``SHIFT``;
    rows that repeat come back as often; without labels all scores are 0. Other columns aren't read.
    """
    spark = docs.sparkSession
    found = fit(docs, labels, train_rows, id_col, text_col, label_col, max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if found is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(found)  # what L1 left: at most DIMENSIONS weights

    def scores(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, bias = sent.value
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[at] = kept
        cache: dict[bytes, int] = {}
        for batch in them:
            out = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                x = features(t.as_py() or b"", cache)
                hit = np.unique(x[weights[x] != 0])
                out[i] = bias + float(weights[hit].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + SHIFT, -35, 35))))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scores, f"id {kind}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of the documents, learnt outside the held-out fifth."""
    held_out = label_fold(F.col("id"), 5) == 0
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
