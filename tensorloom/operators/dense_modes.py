"""Semi-sparse tensors with several dense modes: a block of their values for each tuple of the sparse ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.operators.products import IN_PLACE, WIDE
from tensorloom.operators.reshape import dense_fiber
from tensorloom.tensor import SparseTensor, bounded, mode_names

#: Values that a block may have at most (16 MB).
MOST_VALUES = 1 << 21


@dataclass
class BlockTensor:
    """``df``: the sparse modes and ``block``, the values of the dense ones, in the order of ``dense``, the last fastest."""

    df: DataFrame
    ndims: tuple[int, ...]
    dense: tuple[int, ...]

    def __post_init__(self):
        self.ndims, self.dense = tuple(map(int, self.ndims)), tuple(map(int, self.dense))
        if len(self.ndims) < 2 or not self.dense or len({*self.dense}) != len(self.dense) or not {*self.dense} <= {*range(len(self.ndims))}:
            raise ShapeMismatchError(f"dense modes {self.dense} of {len(self.ndims)}; two modes are needed at least")
        if prod(self.sizes) > MOST_VALUES:
            raise ShapeMismatchError(f"a block of {prod(self.sizes)} values; at most {MOST_VALUES}")

    @property
    def sparse(self) -> list[str]:
        return [m for k, m in enumerate(mode_names(len(self.ndims))) if k not in self.dense]

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(self.ndims[k] for k in self.dense)

    @property
    def strides(self) -> tuple[int, ...]:
        """How far apart in a block neighbours in each dense mode are."""
        return tuple(prod(self.sizes[j + 1 :]) for j in range(len(self.dense)))


def to_blocks(x: SparseTensor, dense: Sequence[int]) -> BlockTensor:
    """The modes ``dense`` as blocks, in that order; entries with equal coordinates are summed."""
    out = BlockTensor(x.df, x.ndims, tuple(dense))
    at = sum((F.col(f"i{k}") * s for k, s in zip(out.dense, out.strides)), F.lit(0).cast("bigint"))
    cells = x.dealt(out.sparse).select(*out.sparse, at.alias("k"), "v").groupBy(*out.sparse, "k").agg(F.sum("v").alias("v"))
    rows = cells.groupBy(*out.sparse).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("at"))
    if not out.sparse:
        rows = rows.where(F.size("at") > 0)
    return BlockTensor(rows.select(*out.sparse, dense_fiber("at", prod(out.sizes)).alias("block")), x.ndims, out.dense)


def from_blocks(y: BlockTensor, epsilon: float = 1e-6) -> SparseTensor:
    """Entries of the blocks that are NaN, infinite, or at least ``epsilon`` (> 0) in magnitude."""
    if epsilon <= 0:
        raise TensorValueError("epsilon must be positive")
    cells = y.df.select(*y.sparse, F.posexplode("block").alias("_k", "v")).where(F.isnan("v") | (F.abs("v") >= epsilon))
    inside = [F.floor(F.col("_k") / s).cast("bigint") % n for s, n in zip(y.strides, y.sizes)]
    return SparseTensor(cells.select(*y.sparse, *(c.alias(f"i{k}") for k, c in zip(y.dense, inside)), "v"), y.ndims)


def _replaced(ndims: Sequence[int], mode: int, size: int) -> tuple[int, ...]:
    return tuple(size if k == mode else d for k, d in enumerate(ndims))


def ttm_dense(y: BlockTensor, u: DataFrame, mode: int, nrows: int, ncols: int) -> BlockTensor:
    """A dense mode times U (row, vals), which stays dense: block by block, without a shuffle. U has ``IN_PLACE`` values at most."""
    if mode not in y.dense:
        raise ShapeMismatchError(f"mode {mode} isn't dense")
    if nrows != y.ndims[mode]:
        raise ShapeMismatchError(f"{nrows} rows for a mode of {y.ndims[mode]}")
    if nrows * ncols > IN_PLACE:
        raise ShapeMismatchError(f"{nrows} times {ncols} values; at most {IN_PLACE}")
    matrix = np.zeros((nrows, ncols))
    for r in u.select("row", "vals").collect():  # IN_PLACE values
        matrix[r["row"]] = r["vals"]
    out = BlockTensor(y.df, _replaced(y.ndims, mode, ncols), y.dense)
    sizes, axis, names, width = y.sizes, y.dense.index(mode), [*y.sparse, "block"], prod(out.sizes)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            values = batch.column("block").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), *sizes)
            values = np.moveaxis(np.tensordot(values, matrix, axes=(axis + 1, 0)), -1, axis + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(m) for m in names[:-1]), lists], names=names)

    out.df = y.df.select(*names).mapInArrow(batches, ", ".join([*(f"{m} bigint" for m in names[:-1]), "block array<double>"]))
    return out


def ttm_sparse(y: BlockTensor, u: DataFrame, mode: int, nrows: int, ncols: int) -> BlockTensor:
    """A sparse mode times U (row, vals): the mode becomes dense, the fastest one, and blocks with equal other modes are added.

    U joins on the mode, broadcast where its size allows; a block and a row of U give one larger block. Small blocks are
    summed in as many columns, larger ones value by value.
    """
    if mode in y.dense or not 0 <= mode < len(y.ndims):
        raise ShapeMismatchError(f"mode {mode} isn't sparse")
    if nrows != y.ndims[mode]:
        raise ShapeMismatchError(f"{nrows} rows for a mode of {y.ndims[mode]}")
    out = BlockTensor(y.df, _replaced(y.ndims, mode, ncols), (*y.dense, mode))
    met = y.df.join(bounded(u.select(F.col("row").alias(f"i{mode}"), F.col("vals").alias("_u")), nrows, ncols), f"i{mode}")
    width = prod(out.sizes)
    if width <= WIDE:
        cell = lambda k: F.sum(F.col("block")[k // ncols] * F.col("_u")[k % ncols])
        out.df = met.groupBy(*out.sparse).agg(F.array(*map(cell, range(width))).alias("block"))
    else:
        products = F.flatten(F.transform("block", lambda b: F.transform("_u", lambda w: b * w)))
        cells = met.select(*out.sparse, F.posexplode(products).alias("k", "v")).groupBy(*out.sparse, "k").agg(F.sum("v").alias("v"))
        out.df = cells.groupBy(*out.sparse).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("block"))
    if not out.sparse:
        out.df = out.df.where(F.col("block")[0].isNotNull() if width <= WIDE else F.size("block") > 0)
    return out


def ttm(y: BlockTensor, u: DataFrame, mode: int, nrows: int, ncols: int) -> BlockTensor:
    """Any mode times U; the tensor stays in blocks."""
    return (ttm_dense if mode in y.dense else ttm_sparse)(y, u, mode, nrows, ncols)


def norm_squared_df(y: BlockTensor) -> DataFrame:
    return y.df.agg(F.coalesce(F.sum(F.aggregate("block", F.lit(0.0), lambda s, b: s + b * b)), F.lit(0.0)).alias("norm_sq"))


def scale(y: BlockTensor, by: float) -> BlockTensor:
    return BlockTensor(y.df.withColumn("block", F.transform("block", lambda b: b * F.lit(float(by)))), y.ndims, y.dense)


def add(y: BlockTensor, z: BlockTensor) -> BlockTensor:
    """Two tensors of one shape and the same dense modes; blocks that only one has count as they are."""
    if (y.ndims, y.dense) != (z.ndims, z.dense):
        raise ShapeMismatchError(f"{y.ndims} dense in {y.dense} and {z.ndims} dense in {z.dense}")
    if not y.sparse:
        both = y.df.withColumn("_z", F.lit(0)).unionByName(z.df.withColumn("_z", F.lit(0)))
        cells = both.select(F.posexplode("block").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        return BlockTensor(cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("block")), y.ndims, y.dense)
    met = y.df.join(z.df.withColumnRenamed("block", "_z"), y.sparse, "full")
    both = F.coalesce(F.zip_with("block", "_z", lambda a, b: a + b), "block", "_z")
    return BlockTensor(met.select(*y.sparse, both.alias("block")), y.ndims, y.dense)
