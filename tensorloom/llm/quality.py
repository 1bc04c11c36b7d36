"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import label_fold, materialize, scratch, table

#: Statistics of a document, Fourier features of them, ridge penalty a row, cells of the calibration.
STATS, FEATURES, RIDGE, CELLS = 22, 256, 1e-6, 512
#: The Gaussian kernel's exponent at one standard deviation in every statistic is half the square of this.
SHARPNESS = 0.5
#: Partitions over which the normal equations are summed, at most.
SUMS = 64
_BLOCK = 64


def statistics(text: bytes) -> list[float]:
    """STATS numbers of a UTF-8 text, all zero for an empty one."""
    if not text:
        return [0.0] * STATS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    upper, lower, digits = (int(counts[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58)))
    letters = max(1, upper + lower + int(counts[128:].sum()))
    share = counts[counts > 0] / n
    words = text.split()
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    many = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    symbols = sum(int(counts[ord(c)]) for c in "#$%&*@^~=+<>\\_")
    return [
        np.log1p(n), np.log1p(len(words)), upper / letters, lower / letters, digits / n, int(counts[ord("!")]) / many, int(counts[ord("|")]) / many, symbols / many,
        sum(int(counts[ord(c)]) for c in ".,;:?") / many, int(counts[128:].sum()) / n, int(counts[10]) / n * 100, -float((share * np.log2(share)).sum()),
        float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), len(seen) / many, max(seen.values(), default=0) / many,
        sum(a == b for a, b in zip(words, words[1:])) / many, np.log1p(len(lines)), len(words) / len(lines) / 10, len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) for every row."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            x = [statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATS)


def new_model(mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> dict:
    """What fitting starts from: the moments and the draws of the random features."""
    draw = np.random.default_rng(seed)
    return {"mean": mean, "scale": scale, "w": SHARPNESS * draw.normal(size=(STATS, FEATURES)) / np.sqrt(STATS), "b": draw.uniform(0, 2 * np.pi, FEATURES)}


def features(model: dict, x: np.ndarray) -> np.ndarray:
    """A constant and FEATURES random cosines, whose products approximate a Gaussian kernel."""
    z = np.clip((x - model["mean"]) / model["scale"], -5, 5)
    return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ model["w"] + model["b"])])


def calibrated(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in [0, 1]; a thousandth is left to the raw score, to keep its order on the steps."""
    raw = features(model, x) @ model["all"]
    return np.clip(0.999 * np.interp(raw, *model["steps"]) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step means of y (weights n) over ascending x, by pooling violators."""
    blocks: list[list[float]] = []
    for a, b, m in zip(x, y, n):
        blocks.append([a, b, m])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, m2 = blocks.pop()
            a1, b1, m1 = blocks.pop()
            blocks.append([(a1 * m1 + a2 * m2) / (m1 + m2), (b1 * m1 + b2 * m2) / (m1 + m2), m1 + m2])
    return np.array([k[0] for k in blocks]), np.array([k[1] for k in blocks])


def fit(train: DataFrame) -> dict | None:
    """A model from (x, y, part): statistics, label in [0, 1], part 0 or 1 of the rows. None without rows.

    Each partition sums the normal equations of its rows, and blocks of rows of these sums meet by part and
    block; the driver solves systems of FEATURES + 1 unknowns. Rows are calibrated on scores of the model
    that was fitted without their part, averaged in at most CELLS cells.
    """
    spark = train.sparkSession
    moments = train.agg(F.count("*"), F.array(*(F.avg(F.col("x")[i]) for i in range(STATS))), F.array(*(F.stddev_pop(F.col("x")[i]) for i in range(STATS)))).first()
    if not moments[0]:
        return None
    model = new_model(np.array(moments[1]), np.maximum(np.array(moments[2]), 1e-6))
    sent = spark.sparkContext.broadcast(model)

    def sums(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 2, FEATURES + 1))
        for batch in them:
            phi, y, part = features(sent.value, _matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for p in (0, 1):
                own = phi[part == p]
                total[p, :-1] += own.T @ own
                total[p, -1] += y[part == p] @ own
        rows = [(p, k, total[p, k : k + _BLOCK].tobytes()) for p in (0, 1) for k in range(0, FEATURES + 2, _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "block", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
        return pd.DataFrame({"part": pdf["part"][:1], "block": pdf["block"][:1], "sums": [total.tobytes()]})

    parts = min(SUMS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "part bigint, block bigint, sums binary"
    rows = train.select("x", "y", "part").repartition(parts).mapInArrow(sums, schema).groupBy("part", "block").applyInPandas(added, schema).collect()  # a dozen rows
    total = np.zeros((2, FEATURES + 2, FEATURES + 1))
    for r in rows:
        block = np.frombuffer(r["sums"]).reshape(-1, FEATURES + 1)
        total[r["part"], r["block"] : r["block"] + len(block)] = block

    def solved(t: np.ndarray) -> np.ndarray:
        ridge = np.eye(FEATURES + 1) * RIDGE * max(1.0, t[0, 0])
        ridge[0, 0] = 1e-9
        return np.linalg.solve(t[:-1] + ridge, t[-1])

    model["all"] = solved(total[0] + total[1])
    sent = spark.sparkContext.broadcast(model | {"without": (solved(total[1]), solved(total[0]))})

    def scored(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            phi, part, (w0, w1) = features(sent.value, _matrix(batch.column(0))), batch.column(2).to_numpy(), sent.value["without"]
            s = np.where(part == 0, phi @ w0, phi @ w1)
            cell = np.floor(np.clip((s + 0.5) / 2, 0, 1 - 1e-9) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(s), batch.column(1)], names=["cell", "s", "y"])

    cells = train.select("x", "y", "part").mapInArrow(scored, "cell bigint, s double, y double").groupBy("cell").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("s")  # at most CELLS rows
    model["steps"] = isotonic(cells["s"].to_numpy(), cells["y"].to_numpy(), cells["n"].to_numpy())
    return model


def fitted(stats: DataFrame, labels: DataFrame, train_rows, id_col: str, label_col: str) -> dict | None:
    """The model of those of ``stats`` (id, x) with labels that meet ``train_rows``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & train_rows)
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    train = materialize(stats.join(known, "id").select("x", "y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("bigint").alias("part")), "train")
    return fit(train)


def score(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score double) for every row of ``docs``: how likely its label is 1.

    ``train_rows``: a condition on the labels' ``id``; only labelled rows that meet it are learnt from, each
    id once, with the mean of its labels; null labels don't count. Null texts are empty, and an empty text
    has statistics, and a score, like any other; rows that repeat come back as often; without any label to
    learn from all scores are 0.5. Other columns aren't read.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = fitted(stats, labels, train_rows, id_col, label_col)
    if model is None:
        return stats.select("id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibrated(sent.value, _matrix(batch.column(1))))], names=["id", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(scores, f"id {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more by ``score``; all their columns, whatever their names.

    Statistics are written for the fit, and taken again row by row as texts are read: neither texts nor rows are
    shuffled or written. Nulls, empty texts, repeated rows and rows without labels as in ``score``; ties at 0.5
    stay; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        model = fitted(materialize(document_statistics(docs, id_col, text_col), "statistics"), labels, train_rows, id_col, label_col)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([statistics((t or "").encode()) for t in texts], np.float32).astype(np.float64).reshape(-1, STATS)
        return pd.Series(calibrated(sent.value, x))

    return docs.where(scored(F.col(text_col)) >= 0.5)


def op1_quality(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Scores of the documents, learnt outside the held-out third."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    scored = score(docs, table(spark, sf_dir, "labels"), label_fold(F.col("id"), 3) != 1)
    return scored.select(F.col("id").alias("doc_id"), (label_fold(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
