"""Contractions and products: TTM, TTV, MTTKRP, Kronecker, Khatri-Rao."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.tensor import BROADCAST_BYTES, SemiSparseTensor, SparseTensor, bounded

#: Rank up to which a contraction has one aggregate a column; beyond, columns become rows.
WIDE = 64
#: Entries that a Kronecker product may have without being told otherwise.
MOST_ENTRIES = 10**9
#: Entries of a matrix up to which it is sent whole to a fiber's task (a megabyte).
IN_PLACE = 1 << 17


def ttm(x: SparseTensor, u: DataFrame, mode: int, nrows: int, ncols: int) -> SemiSparseTensor:
    """Y[rest, r] = sum over k of X[rest, k] U[k, r]; ``u`` is (row, vals), nrows by ncols.

    U joins on the contracted mode, broadcast if its size allows, and one aggregate sums by the other modes.
    """
    x.check_mode(mode)
    if nrows != x.ndims[mode]:
        raise ShapeMismatchError(f"{nrows} rows for a mode of {x.ndims[mode]}")
    rest, dims = x.rest(mode), tuple(ncols if k == mode else d for k, d in enumerate(x.ndims))
    met = x.df.join(bounded(u.select(F.col("row").alias(f"i{mode}"), F.col("vals").alias("_u")), nrows, ncols), f"i{mode}")
    if ncols <= WIDE:
        out = met.groupBy(*rest).agg(F.array(*(F.sum(F.col("v") * F.col("_u")[r]) for r in range(ncols))).alias("fiber"))
    else:
        cells = met.select(*rest, "v", F.posexplode("_u").alias("_r", "_w")).groupBy(*rest, "_r").agg(F.sum(F.col("v") * F.col("_w")).alias("s"))
        out = cells.groupBy(*rest).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "s"))), lambda c: c["s"]).alias("fiber"))
    return SemiSparseTensor(out, dims, mode)


def ttv(x: SparseTensor, w: DataFrame, mode: int, length: int) -> SemiSparseTensor:
    """Y[rest] = sum over k of X[rest, k] w[k]; ``w`` is (pos, v). The mode's size becomes 1."""
    return ttm(x, w.select(F.col("pos").alias("row"), F.array("v").alias("vals")), mode, length, 1)


def spark_matrix(u: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """One row: ``u`` (row, vals) as an array of its columns, rows that are missing as zeros."""
    every = u.sparkSession.range(nrows).withColumnRenamed("id", "row").join(u.select("row", "vals"), "row", "left")
    rows = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("row", F.coalesce("vals", F.array_repeat(F.lit(0.0), ncols)).alias("vals")))), lambda r: r["vals"]).alias("_rows"))
    column = lambda k: F.transform("_rows", lambda r: r[k])
    return rows.select(F.array(*map(column, range(ncols))).alias("_columns"))


def sttm(y: SemiSparseTensor, u: DataFrame, mode: int, nrows: int, ncols: int) -> SemiSparseTensor:
    """The dense mode of a semi-sparse tensor times U: fiber by fiber where U is small (no shuffle), else entry by entry."""
    if mode != y.mode:
        raise ShapeMismatchError(f"mode {mode}, but mode {y.mode} is dense")
    if nrows != y.ndims[mode]:
        raise ShapeMismatchError(f"{nrows} rows for a mode of {y.ndims[mode]}")
    if nrows * ncols <= IN_PLACE:
        columns = spark_matrix(u, nrows, ncols)
        dot = lambda c: F.aggregate(F.zip_with("fiber", c, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
        met = y.df.crossJoin(F.broadcast(columns)).select(*y.rest, F.transform("_columns", dot).alias("fiber"))
        return SemiSparseTensor(met, tuple(ncols if k == mode else d for k, d in enumerate(y.ndims)), mode)
    cells = y.df.select(*y.rest, F.posexplode("fiber").alias(f"i{mode}", "v")).withColumn(f"i{mode}", F.col(f"i{mode}").cast("bigint"))
    return ttm(SparseTensor(cells, y.ndims), u, mode, nrows, ncols)


def mttkrp(x: SparseTensor, factors: Sequence[DataFrame | None], mode: int, rank: int, dense: bool = True, order: Sequence[int] | None = None, dealt: DataFrame | None = None, by: Sequence[str] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """(row, vals): M[i, r] = sum over entries with index i of v times the other factors' values of column r.

    ``factors``: (row, vals) for each mode (that of ``mode`` isn't read). They join in ``order``, broadcast
    where their known size is within ``limit``. The aggregate is partial before its shuffle, so a hot index costs a row a
    task and column. dense: rows without entries are zero; else they are left out. dealt: the
    entries with further columns ``by``, which the row determines and by which they are dealt out already.
    """
    x.check_mode(mode)
    if len(factors) != x.nmodes:
        raise ShapeMismatchError(f"{len(factors)} factors for {x.nmodes} modes")
    df, names = x.df if dealt is None else dealt, []
    for k in order or [(mode + j) % x.nmodes for j in range(1, x.nmodes)]:
        if k == mode:
            continue
        names.append(f"_u{k}")
        df = df.join(bounded(factors[k].select(F.col("row").alias(f"i{k}"), F.col("vals").alias(f"_u{k}")), x.ndims[k], rank, limit), f"i{k}")
    key = F.col(f"i{mode}").alias("row")
    if rank <= WIDE:
        out = df.groupBy(*by, key).agg(F.array(*(F.sum(reduce(lambda a, n: a * F.col(n)[r], names, F.col("v"))) for r in range(rank))).alias("vals")).select("row", "vals")
    else:
        products = reduce(lambda a, n: F.zip_with(a, F.col(n), lambda p, q: p * q), names[1:], F.transform(names[0], lambda p: p * F.col("v")))
        cells = df.select(key, F.posexplode(products).alias("_r", "s")).groupBy("row", "_r").agg(F.sum("s").alias("s"))
        out = cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "s"))), lambda c: c["s"]).alias("vals"))
    if not dense:
        return out
    every = x.df.sparkSession.range(x.ndims[mode]).withColumnRenamed("id", "row")
    zero = F.array_repeat(F.lit(0.0), rank)
    return every.join(bounded(out, x.ndims[mode], rank, limit), "row", "left").select("row", F.coalesce("vals", zero).alias("vals"))


def khatri_rao(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    """Entries with equal last index multiplied; the other modes' indices are iA * J + iB."""
    if a.nmodes != b.nmodes:
        raise ShapeMismatchError(f"{a.nmodes} and {b.nmodes} modes")
    if a.ndims[-1] != b.ndims[-1]:
        raise ShapeMismatchError("the last modes differ")
    last = a.modes[-1]
    other = b.df.select(*(F.col(m).alias(f"_{m}") if m != last else F.col(m) for m in b.modes), F.col("v").alias("_v"))
    cols = [(F.col(m) * b.ndims[k] + F.col(f"_{m}")).alias(m) for k, m in enumerate(a.modes[:-1])]
    out = a.df.join(other, last).select(*cols, last, (F.col("v") * F.col("_v")).alias("v"))
    return SparseTensor(out, tuple(p * q for p, q in zip(a.ndims[:-1], b.ndims[:-1])) + a.ndims[-1:])


def kronecker(a: SparseTensor, b: SparseTensor, most: int = MOST_ENTRIES) -> SparseTensor:
    """Every entry times every entry, all indices iA * J + iB: by definition nnz(A) * nnz(B) entries.

    More than ``most`` are refused. The smaller tensor is sent to the tasks if its counted size allows.
    """
    if a.nmodes != b.nmodes:
        raise ShapeMismatchError(f"{a.nmodes} and {b.nmodes} modes")
    n, m = a.nnz, b.nnz
    if n * m > most:
        raise TensorValueError(f"{n} times {m} entries; at most {most}")
    other = bounded(b.df.select(*(F.col(c).alias(f"_{c}") for c in b.df.columns)), m, b.nmodes + 1)
    cols = [(F.col(k) * d + F.col(f"_{k}")).alias(k) for k, d in zip(a.modes, b.ndims)]
    return SparseTensor(a.df.crossJoin(other).select(*cols, (F.col("v") * F.col("_v")).alias("v")), tuple(p * q for p, q in zip(a.ndims, b.ndims)))
