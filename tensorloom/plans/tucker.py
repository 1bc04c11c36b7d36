"""Tucker decomposition by higher-order orthogonal iteration; an extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError
from tensorloom.operators import dense_modes, matrix
from tensorloom.operators.dense_modes import BlockTensor
from tensorloom.operators.products import ttm
from tensorloom.storage import materialize, scratch
from tensorloom.tensor import SparseTensor

#: Tasks that put triangular factors together, before the driver does.
FAN = 32


def triangular(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of a tall matrix (row, vals) of ``width`` columns.

    Each task decomposes its rows, some thousand at a time, and sends its R; ``FAN`` tasks do so with these, and the
    driver with the last ``FAN``.
    """

    def step(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in them:
            r = np.linalg.qr(np.vstack([r, batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)]), mode="r")
        whole = np.zeros((width, width))
        whole[: len(r)] = r
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.array([0, width * width], np.int32)), pa.array(whole.reshape(-1)))], names=["vals"])

    out = rows.select("vals").mapInArrow(step, "vals array<double>").repartition(FAN).mapInArrow(step, "vals array<double>")
    found = [np.array(r["vals"]).reshape(width, width) for r in out.collect()]  # FAN small matrices
    return np.linalg.qr(np.vstack([np.zeros((1, width)), *found]), mode="r")


def leading(rows: DataFrame, width: int, rank: int) -> DataFrame:
    """(row, vals): the ``rank`` leading left singular vectors of a tall matrix (row, vals)."""
    _, sigma, v = np.linalg.svd(triangular(rows, width))
    return matrix.times_small(rows, v[:rank].T / np.maximum(sigma[:rank], 1e-30))


def _contracted(y: SparseTensor | BlockTensor, u: DataFrame, mode: int, rank: int) -> BlockTensor:
    if isinstance(y, BlockTensor):
        return dense_modes.ttm(y, u, mode, y.ndims[mode], rank)
    z = ttm(y, u, mode, y.ndims[mode], rank)
    return BlockTensor(z.df.withColumnRenamed("fiber", "block"), z.ndims, (mode,))


def _update(y: SparseTensor | BlockTensor, modes: Sequence[int], factors: list[DataFrame], ranks: Sequence[int], done: Callable[[BlockTensor, int], None]) -> None:
    """Renews the factors of ``modes``, which alone are still sparse in ``y``: half of them after contracting the other half, and the other way round.

    So modes of one half share the products of the other: the dimension tree.
    """
    if len(modes) == 1:
        return done(y, modes[0])
    half = len(modes) // 2
    for mine, others in ((modes[:half], modes[half:]), (modes[half:], modes[:half])):
        z = y
        for k in others:
            z = _contracted(z, factors[k], k, ranks[k])
        _update(BlockTensor(materialize(z.df, "partial"), z.ndims, z.dense), mine, factors, ranks, done)


def tucker(x: SparseTensor, ranks: Sequence[int], niters: int = 3, seed: int = 0) -> tuple[SparseTensor, list[DataFrame]]:
    """(core, factors), the factors' columns orthonormal. x times all factors but one stays in blocks, whose rows are the
    unfolding of the mode left; its singular vectors come from triangular factors, partition by partition.
    """
    if len(ranks) != x.nmodes or x.nmodes < 2:
        raise ShapeMismatchError(f"{len(ranks)} ranks for {x.nmodes} modes; two are needed at least")
    for m, (d, r) in enumerate(zip(x.ndims, ranks)):
        if not 1 <= r <= min(d, prod(ranks) // r):
            raise ShapeMismatchError(f"rank {r} of mode {m}: at most its size and the product of the other ranks")
    spark = x.df.sparkSession
    factors = [matrix.randomize(spark, d, r, seed + k) for k, (d, r) in enumerate(zip(x.ndims, ranks))]
    core: list[SparseTensor] = []

    def renewed(y: BlockTensor, mode: int) -> None:
        rows = y.df.select(F.col(f"i{mode}").alias("row"), F.col("block").alias("vals"))
        factors[mode] = materialize(leading(rows, prod(y.sizes), ranks[mode]), "factor", keep=True)
        if mode == x.nmodes - 1:
            small = dense_modes.from_blocks(dense_modes.ttm(y, factors[mode], mode, y.ndims[mode], ranks[mode]), 1e-300)
            core[:] = [small.with_df(materialize(small.df, "core", keep=True))]

    with scratch(spark):
        held = x.with_df(materialize(x.df, "entries"))
        for _ in range(niters):
            _update(held, list(range(x.nmodes)), factors, ranks, renewed)
    return core[0], factors
