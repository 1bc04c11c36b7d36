"""Reductions and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.tensor import SemiSparseTensor, SparseTensor, bounded


def norm_squared_df(x: SparseTensor) -> DataFrame:
    return x.df.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("norm_sq"))


def norm_squared(x: SparseTensor) -> float:
    return float(norm_squared_df(x).first()[0])


def norm(x: SparseTensor) -> float:
    """Frobenius norm."""
    return math.sqrt(norm_squared(x))


def semi_norm_df(y: SemiSparseTensor) -> DataFrame:
    return y.df.agg(F.sqrt(F.coalesce(F.sum(F.aggregate("fiber", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).alias("norm"))


def density(x: SparseTensor, nnz: int | None = None) -> float:
    """Entries over the product of the sizes, by factors, so that the product can't overflow."""
    n = x.nnz if nnz is None else nnz
    return math.prod(n ** (1 / x.nmodes) / d for d in x.ndims) if n else 0.0


def index_bounds(x: SparseTensor) -> DataFrame:
    """(mode, low, high): least index and largest plus one; (0, 0) for a tensor without entries."""
    stats = x.df.agg(*(f(m).alias(f"{p}{m}") for m in x.modes for p, f in (("lo_", F.min), ("hi_", F.max))))
    rows = F.array(*(F.struct(F.lit(k).alias("mode"), F.coalesce(F.col(f"lo_{m}"), F.lit(0)).alias("low"), F.coalesce(F.col(f"hi_{m}") + 1, F.lit(0)).alias("high")) for k, m in enumerate(x.modes)))
    return stats.select(F.inline(rows))


def slice_sizes(x: SparseTensor, mode: int) -> DataFrame:
    """(idx, nnz) for every index of ``mode``, used or not."""
    x.check_mode(mode)
    counts = x.df.groupBy(F.col(f"i{mode}").alias("idx")).agg(F.count("*").alias("n"))
    return x.df.sparkSession.range(x.ndims[mode]).withColumnRenamed("id", "idx").join(bounded(counts, x.ndims[mode], 2), "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("nnz"))


def status_df(x: SparseTensor) -> DataFrame:
    """(nmodes, nnz, density, bytes, slice_len): a row; slice_len holds entries over size for each mode."""
    cells = float(math.prod(x.ndims))
    return x.df.agg(F.count("*").alias("nnz")).select(
        F.lit(x.nmodes).alias("nmodes"), "nnz", (F.col("nnz") / F.lit(cells)).alias("density"), (F.col("nnz") * (4 * x.nmodes + 4)).alias("bytes"),
        F.array(*(F.col("nnz") / F.lit(float(d)) for d in x.ndims)).alias("slice_len"),
    )


def bytes_string(n: float) -> str:
    """A size in steps of 1024."""
    for unit in ("Bytes", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if n < 1024 or unit == "PiB":
            return f"{n:.0f} {unit}" if unit == "Bytes" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def marginals(x: SparseTensor) -> DataFrame:
    """Sums over every subset of the modes (null: summed over that mode); an extension."""
    return x.df.cube(*x.modes).agg(F.sum("v").alias("v"))


def top_k(x: SparseTensor, k: int) -> SparseTensor:
    """The k entries of largest magnitude; an extension."""
    return x.with_df(x.df.orderBy(F.abs("v").desc(), *x.modes).limit(k))


def status_report(x: SparseTensor) -> str:
    """Sizes, entries, density, entries a slice and bytes, as text."""
    r = status_df(x).first()
    return "\n".join([
        "DIMS=" + "x".join(map(str, x.ndims)) + f" NNZ={r['nnz']}", f"DENSITY={r['density']:e}", "Average slice length: " + ", ".join(f"{s:.2f}" for s in r["slice_len"]), f"COO-STORAGE={bytes_string(r['bytes'])}", "",
    ])
