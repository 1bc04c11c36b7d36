"""Dense matrices as (row, vals array<double>): what factors need."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError
from tensorloom.functions.vectors import resize

#: Rank up to which a Gram matrix is one row of aggregates.
GRAM_WIDE = 32


def constant(spark: SparkSession, nrows: int, ncols: int, value: float) -> DataFrame:
    return spark.range(nrows).select(F.col("id").alias("row"), F.array_repeat(F.lit(float(value)), ncols).alias("vals"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda k: F.when(k == F.col("id"), 1.0).otherwise(0.0))
    return spark.range(n).select(F.col("id").alias("row"), row.alias("vals"))


def randomize(spark: SparkSession, nrows: int, ncols: int, seed: int = 0) -> DataFrame:
    """Uniform in [-3, 3], a function of seed, row and column, whatever the partitions."""
    unit = lambda r: F.pmod(F.xxhash64("id", F.lit(r), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(nrows).select(F.col("id").alias("row"), F.array(*(unit(r) * 6 - 3 for r in range(ncols))).alias("vals"))


def append_rows(a: DataFrame, b: DataFrame, nrows: int) -> DataFrame:
    """``b`` below the ``nrows`` rows of ``a``."""
    return a.unionByName(b.withColumn("row", F.col("row") + nrows))


def resize_rows(a: DataFrame, nrows: int, ncols: int, old: int) -> DataFrame:
    """The first ``nrows`` rows; further ones are zero."""
    kept = a.where(F.col("row") < nrows)
    return kept if nrows <= old else kept.unionByName(a.sparkSession.range(old, nrows).select(F.col("id").alias("row"), F.array_repeat(F.lit(0.0), ncols).alias("vals")))


def resize_cols(a: DataFrame, ncols: int) -> DataFrame:
    return a.select("row", resize(F.col("vals"), ncols, 0.0).alias("vals"))


def exploded(a: DataFrame) -> DataFrame:
    return a.select("row", F.posexplode("vals").alias("col", "v"))


def dot_mul(*mats: DataFrame) -> DataFrame:
    """Hadamard product of matrices with the same rows."""
    named = [m.select("row", F.col("vals").alias(f"_m{k}")) for k, m in enumerate(mats)]
    joined = reduce(lambda x, y: x.join(y, "row"), named)
    return joined.select("row", reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p * q), (F.col(f"_m{k}") for k in range(len(mats)))).alias("vals"))


def inverse_shuffle(a: DataFrame, maps: DataFrame, mode: int) -> DataFrame:
    """out[old] = a[new] by the map of ``mode``."""
    one = maps.where(F.col("mode") == mode).select(F.col("new").alias("row"), "old")
    return a.join(one, "row").select(F.col("old").alias("row"), "vals")


def gram_df(a: DataFrame, rank: int, *more: Column) -> DataFrame:
    """A row with g_p_q (p <= q), the upper triangle of A'A, and ``more`` aggregates."""
    return a.agg(*(F.coalesce(F.sum(F.col("vals")[p] * F.col("vals")[q]), F.lit(0.0)).alias(f"g_{p}_{q}") for p in range(rank) for q in range(p, rank)), *more)


def gram_of_row(r: Row, rank: int) -> np.ndarray:
    """The matrix that ``gram_df`` gave as a row."""
    out = np.zeros((rank, rank))
    for p in range(rank):
        for q in range(p, rank):
            out[p, q] = out[q, p] = r[f"g_{p}_{q}"]
    return out


def gram_entries(a: DataFrame, rank: int) -> DataFrame:
    """(p, q, v) for p <= q: the upper triangle of A'A as rows, for any rank; summed within tasks first."""
    row = lambda p: F.transform(F.slice("vals", p + 1, rank), lambda y, i: F.struct(p.alias("p"), (p + i).alias("q"), (F.get("vals", p) * y).alias("v")))
    cells = a.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), row))).alias("c"))
    return cells.groupBy("c.p", "c.q").agg(F.sum("c.v").alias("v"))


def gram(a: DataFrame, rank: int) -> np.ndarray:
    """A'A in the driver: one aggregate a product up to rank GRAM_WIDE, rows beyond."""
    if rank <= GRAM_WIDE:
        return gram_of_row(gram_df(a, rank).first(), rank)
    out = np.zeros((rank, rank))
    for r in gram_entries(a, rank).collect():  # rank by rank
        out[r["p"], r["q"]] = out[r["q"], r["p"]] = r["v"]
    return out


def col_norms_df(a: DataFrame, rank: int) -> DataFrame:
    return a.agg(F.array(*(F.sqrt(F.sum(F.col("vals")[r] * F.col("vals")[r])) for r in range(rank))).alias("lambda"))


def col_maxima_df(a: DataFrame, rank: int) -> DataFrame:
    """At least 1; of the signed values."""
    return a.agg(F.array(*(F.greatest(F.lit(1.0), F.max(F.col("vals")[r])) for r in range(rank))).alias("lambda"))


def scaled(a: DataFrame, by: list[float]) -> DataFrame:
    """Columns divided by ``by``; a zero leaves its column."""
    return a.select("row", F.array(*(F.col("vals")[r] / F.lit(float(x) if x else 1.0) for r, x in enumerate(by))).alias("vals"))


def norm2(a: DataFrame, rank: int) -> tuple[DataFrame, list[float]]:
    lam = list(col_norms_df(a, rank).first()[0])
    return scaled(a, lam), lam


def max_norm(a: DataFrame, rank: int) -> tuple[DataFrame, list[float]]:
    lam = list(col_maxima_df(a, rank).first()[0])
    return scaled(a, lam), lam


def final_lambda(factors: list[DataFrame], lam: list[float], rank: int) -> tuple[list[DataFrame], list[float]]:
    """Every factor's columns to length one, lambda times the lengths."""
    out = []
    for a in factors:
        a, norms = norm2(a, rank)
        out.append(a)
        lam = [x * y for x, y in zip(lam, norms)]
    return out, lam


def hadamard_grams(grams: list[np.ndarray], mode: int) -> np.ndarray:
    """The product of all Gram matrices but that of ``mode``."""
    return reduce(np.multiply, (g for k, g in enumerate(grams) if k != mode), np.ones_like(grams[0]))


def inverse(g: np.ndarray) -> np.ndarray:
    """By Cholesky; if G isn't positive definite by LU, if it is singular the pseudo-inverse."""
    try:
        low = np.linalg.inv(np.linalg.cholesky(g))
        return low.T @ low
    except np.linalg.LinAlgError:
        pass
    try:
        out = np.linalg.inv(g)
        return out if np.isfinite(out).all() and np.abs(g @ out - np.eye(len(g))).max() < 1e-6 else np.linalg.pinv(g)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(g)


def times_small(a: DataFrame, m: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """Rows times an R by S matrix of the driver, in place; columns ``keep`` stay."""
    if m.ndim != 2:
        raise ShapeMismatchError("a matrix is needed")
    cols = [reduce(lambda x, y: x + y, (F.col("vals")[p] * F.lit(float(m[p, q])) for p in range(m.shape[0]))) for q in range(m.shape[1])]
    return a.select("row", F.array(*cols).alias("vals"), *keep)


def solve_normals(rhs: DataFrame, grams: list[np.ndarray], mode: int, keep: Sequence[str] = ()) -> DataFrame:
    """rhs times the inverse of the product of the other modes' Gram matrices; columns ``keep`` of rhs stay."""
    return times_small(rhs, inverse(hadamard_grams(grams, mode)), keep)
