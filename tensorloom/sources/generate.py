"""Generated tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError
from tensorloom.tensor import SparseTensor, mode_names


def random_tensor(spark: SparkSession, ndims: Sequence[int], density: float, seed: int = 0) -> SparseTensor:
    """About density times the cells, normally distributed values; a function of the seed.

    Cells are numbered and thrown by hash, so that only used cells become rows: work is density times cells.
    """
    if not 0 < density <= 1:
        raise TensorValueError("density in (0, 1]")
    cells = 1
    for d in ndims:
        cells *= d
    n = round(cells * density)
    thrown = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)).alias("cell")).distinct() if density < 0.5 else spark.range(cells).select(F.col("id").alias("cell")).where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < density * (1 << 30))
    cols, stride = [], 1
    for k in reversed(range(len(ndims))):
        cols.append(F.pmod(F.floor(F.col("cell") / F.lit(stride)), F.lit(ndims[k])).cast("bigint").alias(f"i{k}"))
        stride *= ndims[k]
    return SparseTensor(thrown.select(*cols, _normal([F.col("cell")], seed).alias("v")).select(*mode_names(len(ndims)), "v"), ndims)


def rated_tensor(spark: SparkSession, modes: Sequence[tuple[float, int]], seed: int = 0) -> SparseTensor:
    """Normally distributed values at indices drawn mode by mode; ``modes``: (rate, size) of each.

    At a rate of 1 a mode has all its indices. Below, every combination of the modes before draws its own
    rate * size indices, without repeats; a fraction is rounded up with that probability. A function of the seed.
    """
    if not modes or any(not 0 <= r <= 1 or d < 1 for r, d in modes):
        raise TensorValueError("rates in 0 .. 1, sizes of 1 or more")
    df = spark.range(1).select()
    for k, (rate, dim) in enumerate(modes):
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))
        if rate < 1:
            before = [F.col(f"i{j}") for j in range(k)]
            extra = (F.pmod(F.xxhash64(*before, F.lit(seed), F.lit(k)), F.lit(1 << 30)) < (rate * dim - int(rate * dim)) * (1 << 30)).cast("int")
            drawn = F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64(*before, i, F.lit(seed), F.lit(~k)).alias("h"), i.alias("i"))))  # noqa: B023
            every = F.transform(F.slice(drawn, F.lit(1), F.lit(int(rate * dim)) + extra), lambda x: x["i"])
        df = df.select("*", F.explode(every).alias(f"i{k}"))
        if k == 0:
            df = df.repartition(f"i{k}")  # the first mode is made in one task
    return SparseTensor(df.select("*", _normal([F.col(m) for m in mode_names(len(modes))], seed).alias("v")), tuple(d for _, d in modes))


def _normal(keys: Sequence[Column], seed: int) -> Column:
    unit = lambda s: (F.pmod(F.xxhash64(*keys, F.lit(seed + s)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(unit(2) * 6.283185307179586)


def diagonal_tensor(spark: SparkSession, dim: int, nmodes: int = 3, diagonals: int = 5, seed: int = 0) -> SparseTensor:
    """A stencil with normally distributed values: (i, i, i) and, where they exist, (i, i-s, i), (i, i, i-s), (i, i, i+s)
    and (i, i+s, i), with s the cube root of the size, rounded down. Three modes and five diagonals only."""
    if nmodes != 3 or diagonals != 5:
        raise TensorValueError("three modes and five diagonals")
    s = int(dim ** (1.0 / 3))
    i = F.col("i0")
    cells = F.array(*(F.struct((i + a).alias("i1"), (i + b).alias("i2")) for a, b in ((-s, 0), (0, -s), (0, 0), (0, s), (s, 0))))
    rows = spark.range(dim).select(F.col("id").alias("i0")).select("i0", F.explode(cells).alias("c")).select("i0", "c.i1", "c.i2")
    rows = rows.where(F.col("i1").between(0, dim - 1) & F.col("i2").between(0, dim - 1))
    return SparseTensor(rows.select("*", _normal([F.col(m) for m in mode_names(3)], seed).alias("v")), (dim,) * 3)
