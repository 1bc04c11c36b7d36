"""CP decomposition by alternating least squares, over entries or blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators import matrix
from tensorloom.operators.hicoo import HiCOO, to_coo
from tensorloom.operators.hicoo import norm_squared_df as hicoo_norm
from tensorloom.operators.products import mttkrp
from tensorloom.operators.reduce import norm_squared_df
from tensorloom.storage import materialize
from tensorloom.tensor import A_TASK, SparseTensor, bounded, within_bytes

#: Bytes of a factor up to which a step broadcasts it: a broadcast passes through the driver, and every step has some.
STEP_BYTES = 20 << 20


@dataclass
class KruskalTensor:
    """lambda, a factor (row, vals) for each mode, and how well they fit."""

    ndims: tuple[int, ...]
    rank: int
    lam: list[float]
    factors: list[DataFrame]
    fit: float

    def dump(self) -> str:
        """As text; the factors' rows are fetched: for small dimensions."""
        lines = [f"nmodes: {len(self.ndims)}, rank: {self.rank}", "ndims: " + " ".join(map(str, self.ndims)), f"fit: {self.fit:.6f}", "lambda:", "\t".join(f"{x:.2f}" for x in self.lam)]
        for k, a in enumerate(self.factors):
            lines.append(f"mode {k}: {self.ndims[k]} x {self.rank} matrix")
            lines += ["\t".join(f"{x:.2f}" for x in r["vals"]) for r in a.orderBy("row").collect()]
        return "\n".join(lines) + "\n"

    def inverse_shuffle(self, maps: DataFrame) -> KruskalTensor:
        """Factors of the tensor before it was relabelled by ``maps``."""
        return KruskalTensor(self.ndims, self.rank, self.lam, [matrix.inverse_shuffle(a, maps, k) for k, a in enumerate(self.factors)], self.fit)


def model_norm_squared(lam: list[float], grams: list[np.ndarray]) -> float:
    v = np.array(lam)
    return float(abs(v @ matrix.hadamard_grams(grams, -1) @ v))


def inner_df(last: DataFrame, product: DataFrame, lam: list[float], rows: int) -> DataFrame:
    """<X, M> from the last factor and the last MTTKRP, by rows."""
    rank = len(lam)
    met = last.select("row", F.col("vals").alias("_a")).join(bounded(product, rows, rank), "row")
    return met.agg(F.coalesce(sum((F.lit(float(x)) * F.sum(F.col("_a")[r] * F.col("vals")[r]) for r, x in enumerate(lam)), F.lit(0.0)), F.lit(0.0)).alias("inner"))


def fit_of(norm_sq: float, model_sq: float, inner: float) -> float:
    """1 - |X - M| / |X|; a residual that rounding made negative isn't rooted."""
    if not norm_sq:
        return 0.0
    left = norm_sq + model_sq - 2 * inner
    return 1 - (math.sqrt(left) if left > 0 else left) / math.sqrt(norm_sq)


def _sums(solved: DataFrame, rank: int) -> tuple[np.ndarray, list[float], float]:
    """Of (row, vals, product): the Gram matrix of vals, the largest value or 1 of its columns, and its inner product with product.

    The last is <X, M>: lambda times the normalized factor is vals.
    """
    met = reduce(lambda a, b: a + b, (F.col("vals")[r] * F.col("product")[r] for r in range(rank)))
    more = [F.coalesce(F.sum(met), F.lit(0.0)).alias("inner"), F.array(*(F.greatest(F.lit(1.0), F.max(F.col("vals")[r])) for r in range(rank))).alias("most")]
    if rank > matrix.GRAM_WIDE:
        gram, rest = matrix.gram(solved, rank), solved.agg(*more).first()
    else:
        rest = matrix.gram_df(solved, rank, *more).first()
        gram = matrix.gram_of_row(rest, rank)
    return gram, [float(x) for x in rest["most"]], float(rest["inner"])


def _scaled_gram(gram: np.ndarray, by: list[float]) -> np.ndarray:
    """The Gram matrix of the columns divided by ``by``; a zero leaves its column."""
    by = np.array([x or 1.0 for x in by])
    return gram / np.outer(by, by)


def cpd_als(x: SparseTensor | HiCOO, rank: int = 16, niters: int = 5, tol: float = 1e-5, seed: int = 0) -> KruskalTensor:
    """CP decomposition. A step contracts, solves for the mode, normalizes (2-norm in the first iteration, then
    the largest value or 1) and refreshes that mode's Gram matrix; the fit reuses the last contraction.

    A step is two jobs: contraction and solution are written to the shared folder side by side, so that a plan
    never holds more than one step; one aggregate then takes the Gram matrix, the largest values and the inner
    product, and normalizing scales them in the driver, which handles rank by rank matrices only.

    Where a factor is too large to be broadcast in every step, the entries (of blocks: unpacked) are dealt out once by that mode, the
    largest, and kept sorted on the executors' disks: its factor comes to them then, and its sums aren't shuffled.
    """
    blocked = isinstance(x, HiCOO)
    spark, n = x.df.sparkSession, len(x.ndims)
    x = HiCOO(materialize(x.df, "blocks"), x.ndims, x.sb_bits, x.sk_bits) if blocked else x.with_df(materialize(x.df, "entries"))
    norm_sq = float((hicoo_norm(x) if blocked else norm_squared_df(x)).first()[0])
    entries, kept = to_coo(x) if blocked else x, None
    largest = max(range(n), key=lambda k: x.ndims[k])
    if not within_bytes(x.ndims[largest], rank, STEP_BYTES):
        parts = max(spark.sparkContext.defaultParallelism, -(-entries.nnz // A_TASK))
        kept = entries.df.repartition(parts, f"i{largest}").sortWithinPartitions(f"i{largest}").persist(StorageLevel.DISK_ONLY)
        entries = entries.with_df(kept)
    factors = [matrix.randomize(spark, d, rank, seed + k) for k, d in enumerate(x.ndims)]
    grams = [matrix.gram(a, rank) for a in factors]
    lam, fit, product = [1.0] * rank, 0.0, None
    for it in range(niters):
        for m in range(n):
            product = mttkrp(entries, factors, m, rank, limit=STEP_BYTES).withColumn("product", F.col("vals"))
            solved = materialize(matrix.solve_normals(product, grams, m, keep=["product"]), "solved")
            gram, most, inner = _sums(solved, rank)
            lam = list(np.sqrt(np.diag(gram))) if it == 0 else most
            factors[m], grams[m] = matrix.scaled(solved, lam), _scaled_gram(gram, lam)
        before, fit = fit, fit_of(norm_sq, model_norm_squared(lam, grams), inner)
        if it and abs(fit - before) < tol:
            break
    if kept is not None:
        kept.unpersist()
    for m, gram in enumerate(grams):
        norms = list(np.sqrt(np.diag(gram)))
        factors[m], lam = matrix.scaled(factors[m], norms), [float(x * y) for x, y in zip(lam, norms)]
    return KruskalTensor(x.ndims, rank, lam, factors, fit)
