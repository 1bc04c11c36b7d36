"""The sparse tensor: a DataFrame of coordinates ``i0 .. iN-1`` (bigint) and a value ``v`` (double)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.errors import ShapeMismatchError, TensorValueError

#: Bytes of a side (rows and width are known from dimensions) up to which a join broadcasts it.
BROADCAST_BYTES = 64 << 20
#: Entries of a task where they are dealt out by their known number.
A_TASK = 1 << 18


def tasks_of(rows: int) -> int:
    """Tasks that ``rows`` rows ask for."""
    return -(-rows // A_TASK)


def mode_names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def schema(n: int) -> T.StructType:
    return T.StructType([T.StructField(m, T.LongType(), False) for m in mode_names(n)] + [T.StructField("v", T.DoubleType(), False)])


def within_bytes(rows: int, width: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` rows of ``width`` numbers have ``limit`` bytes at most."""
    return rows * (width + 2) * 8 <= limit


def bounded(df: DataFrame, rows: int, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` rows of ``width`` numbers are within ``limit``."""
    return F.broadcast(df) if within_bytes(rows, width, limit) else df


@dataclass
class SparseTensor:
    """N modes of sizes ``ndims``; absent coordinates are zero. Operators return new, lazy tensors."""

    df: DataFrame
    ndims: tuple[int, ...]
    sortorder: tuple[int, ...] | None = field(default=None)
    #: No more entries than that, if it is known.
    most: int | None = field(default=None)
    #: The rows that the entries are aggregates of, and how: ``dealt`` deals them out before they are aggregated.
    rows: tuple[DataFrame, Column] | None = field(default=None)

    def __post_init__(self):
        self.ndims = tuple(int(d) for d in self.ndims)
        want = [*mode_names(len(self.ndims)), "v"]
        if not self.ndims or sorted(self.df.columns) != sorted(want):
            raise ShapeMismatchError(f"columns {self.df.columns} for {len(self.ndims)} modes")
        if self.df.columns != want:
            self.df = self.df.select(*want)

    @staticmethod
    def empty(spark: SparkSession, ndims: Sequence[int]) -> SparseTensor:
        return SparseTensor(spark.createDataFrame([], schema(len(ndims))), tuple(ndims))

    @staticmethod
    def from_rows(spark: SparkSession, rows: Sequence[tuple], ndims: Sequence[int]) -> SparseTensor:
        return SparseTensor(spark.createDataFrame([(*map(int, r[:-1]), float(r[-1])) for r in rows], schema(len(ndims))), tuple(ndims))

    @staticmethod
    def from_dataframe(df: DataFrame, modes: Sequence[Column | str], value: Column | str, ndims: Sequence[int] | None = None, how: str = "sum") -> SparseTensor:
        """One entry for each combination of ``modes`` in ``df``, ``value`` aggregated (sum, count, min, max, avg).

        Rows with a null mode or value are left out. Without ``ndims`` one aggregate finds the largest indices and counts the rows.
        """
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        names = mode_names(len(modes))
        rows = df.select(*(as_col(c).cast("bigint").alias(n) for n, c in zip(names, modes)), as_col(value).cast("double").alias("v")).dropna()
        agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[how]
        out = rows.groupBy(*names).agg(agg("v").cast("double").alias("v"))
        most = None
        if ndims is None:
            *top, most = rows.agg(*(F.max(n) for n in names), F.count("*")).first()
            ndims = tuple((x if x is not None else -1) + 1 for x in top)
        return SparseTensor(out, tuple(ndims), most=most, rows=(rows, agg("v").cast("double").alias("v")))

    @property
    def nmodes(self) -> int:
        return len(self.ndims)

    @property
    def modes(self) -> list[str]:
        return mode_names(self.nmodes)

    @property
    def nnz(self) -> int:
        return self.df.count()

    def rest(self, mode: int) -> list[str]:
        return [m for k, m in enumerate(self.modes) if k != mode]

    def check_mode(self, mode: int) -> None:
        if not 0 <= mode < self.nmodes:
            raise ShapeMismatchError(f"mode {mode} of {self.nmodes}")

    def same_shape(self, other: SparseTensor) -> None:
        if self.ndims != other.ndims:
            raise ShapeMismatchError(f"{self.ndims} and {other.ndims}")

    def with_df(self, df: DataFrame, sortorder: Sequence[int] | None = None) -> SparseTensor:
        return SparseTensor(df, self.ndims, tuple(sortorder) if sortorder is not None else None)

    def copy(self) -> SparseTensor:
        return SparseTensor(self.df, self.ndims, self.sortorder)

    def check_bounds(self) -> SparseTensor:
        """Raise if an index is negative or not below its mode's size."""
        bad = self.df.where(F.greatest(*(((F.col(m) < 0) | (F.col(m) >= d)).cast("int") for m, d in zip(self.modes, self.ndims)), F.lit(0)) == 1)
        if bad.limit(1).count():
            raise TensorValueError("an index is out of bounds")
        return self

    def dealt(self, by: Sequence[Column | str]) -> DataFrame:
        """The entries dealt out by ``by``, to as many tasks as their known number asks for; left as they are if it isn't known.
        Expressions of ``by`` become columns _d0 ...

        So a task's sums don't grow with the tensor, however few tasks the session's settings would make. Where there are
        more cells than these tasks should have entries, rows are dealt out before they are aggregated, once, and aggregated there.
        """
        names = [b if isinstance(b, str) else f"_d{k}" for k, b in enumerate(by)]
        more = [b.alias(n) for b, n in zip(by, names) if not isinstance(b, str)]
        if self.most is None or not by:
            return self.df.select("*", *more)
        spark = self.df.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, tasks_of(self.most))
        if self.rows is None or math.prod(self.ndims) <= A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")):
            return self.df.select("*", *more).repartition(parts, *names)
        rows, agg = self.rows
        return rows.select("*", *more).repartition(parts, *names).groupBy(*dict.fromkeys([*names, *self.modes])).agg(agg)

    def coalesce_duplicates(self) -> SparseTensor:
        """Entries with equal coordinates summed."""
        return self.with_df(self.df.groupBy(*self.modes).agg(F.sum("v").alias("v")))

    def entries(self) -> list[tuple]:
        """All entries, sorted: for small tensors and tests."""
        return sorted(tuple(r) for r in self.df.collect())

    def __add__(self, other):
        from tensorloom.operators.elementwise import add

        return add(self, other)

    def __sub__(self, other):
        from tensorloom.operators.elementwise import sub

        return sub(self, other)

    def __mul__(self, other):
        from tensorloom.operators.elementwise import dot_mul, mul_scalar

        return dot_mul(self, other) if isinstance(other, SparseTensor) else mul_scalar(self, other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        from tensorloom.operators.elementwise import div_scalar, dot_div

        return dot_div(self, other) if isinstance(other, SparseTensor) else div_scalar(self, other)

    def ldivide(self, other):
        """``other / self`` for tensors; ``self / other`` for a scalar."""
        return other / self if isinstance(other, SparseTensor) else self / other


@dataclass
class SemiSparseTensor:
    """One dense mode: ``df`` holds the other modes and ``fiber``, an array of the dense mode's values."""

    df: DataFrame
    ndims: tuple[int, ...]
    mode: int

    def __post_init__(self):
        self.ndims = tuple(int(d) for d in self.ndims)
        if len(self.ndims) < 2 or not 0 <= self.mode < len(self.ndims):
            raise ShapeMismatchError(f"dense mode {self.mode} of {len(self.ndims)}; two modes are needed at least")

    @property
    def rest(self) -> list[str]:
        return [m for k, m in enumerate(mode_names(len(self.ndims))) if k != self.mode]
