"""MTTKRP over blocks: factors in tiles of a block's rows, joined once a block, and kernels dealt out by a balanced schedule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError
from tensorloom.operators.hicoo import HiCOO
from tensorloom.operators.positions import with_pos
from tensorloom.tensor import A_TASK, bounded

#: Products (entries times rank) that a task holds at once.
HELD = 1 << 22
#: Entries of a task that reads its blocks one after another and holds only sums: the more it has, the fewer sums are sent on.
A_STREAM = 1 << 20


def factor_tiles(u: DataFrame, sb_bits: int, rank: int, dim: int | None = None) -> DataFrame:
    """(tile, vals array<double>): 2^sb_bits rows of a factor (row, vals) as one row, one after another; rows that are missing are zeros.
    Of ``dim`` rows, the last tile has no more than are left."""
    side = 1 << sb_bits
    at = F.col("row").bitwiseAND(F.lit(side - 1).cast("bigint"))
    rows = u.groupBy(F.shiftright("row", sb_bits).alias("tile")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "vals"))).alias("rows"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), (n * rank).cast("int"))
    before = lambda i: F.coalesce(F.get(F.col("rows"), i - 1)["at"], F.lit(-1).cast("bigint"))
    filled = F.flatten(F.transform("rows", lambda r, i: F.concat(zeros(r["at"] - before(i) - 1), r["vals"])))
    end = F.lit(side) if dim is None else F.least(F.lit(side), F.lit(dim) - F.col("tile") * side)
    return rows.select("tile", F.concat(filled, zeros(end - 1 - before(F.size("rows")))).alias("vals"))


#: Rows of factors, and for each block of a batch where those of its tile start and how many they are.
Tiles = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(batch: pa.RecordBatch, k: int, rank: int) -> Tiles:
    """The tiles of mode ``k`` that are joined to the blocks."""
    lists = batch.column(f"_u{k}")
    offsets = lists.offsets.to_numpy()
    rows = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).reshape(-1, rank)
    return rows, (offsets[:-1] - offsets[0]) // rank, np.diff(offsets) // rank


def _passing(batch: pa.RecordBatch, k: int, rank: int, last: tuple[int, np.ndarray]) -> tuple[Tiles, tuple[int, np.ndarray]]:
    """The tiles of mode ``k`` that come as rows before their blocks, and the newest one; ``last`` is the newest before ``batch``.
    A block whose tile hasn't come has no rows."""
    rows, first, many = _joined(batch, k, rank)
    tile, comes = batch.column(f"b{k}").to_numpy(), batch.column(f"_u{k}").is_valid().to_numpy(zero_copy_only=False)
    rows, tiles = np.concatenate([last[1], rows]), np.append(last[0], tile)
    first, many = np.append(0, first + len(last[1])), np.append(len(last[1]), many)
    at = np.maximum.accumulate(np.where(comes, np.arange(1, len(batch) + 1), 0))
    newest = at[-1]
    return (rows, first[at], np.where(tiles[at] == tile, many[at], 0)), (tiles[newest], rows[first[newest] : first[newest] + many[newest]].copy())


def _contract(batch: pa.RecordBatch, mode: int, found: dict[int, Tiles], sb_bits: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums): what the blocks of ``batch`` add to rows of the result, a row of sums for each row that they reach."""
    elems = batch.column("elems")
    offsets = elems.offsets.to_numpy()
    *at, v = (f.to_numpy(zero_copy_only=False) for f in elems.values.slice(offsets[0], offsets[-1] - offsets[0]).flatten())
    block = np.repeat(np.arange(len(batch)), np.diff(offsets))
    inside = np.logical_and.reduce([at[k] < many[block] for k, (_, _, many) in found.items()]) if found else np.ones(len(v), bool)
    if not inside.all():
        *at, v, block = (x[inside] for x in (*at, v, block))
    cells = np.repeat(v[:, None], rank, axis=1)
    for k, (rows, first, _) in found.items():
        cells *= rows[first[block] + at[k]]
    row = (batch.column(f"b{mode}").fill_null(0).to_numpy(zero_copy_only=False)[block] << sb_bits) + at[mode]
    return _summed([(row, cells)]) if len(row) else (row, cells)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums by row of (rows, sums) pairs, rows ascending."""
    row, cells = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    row, cells = row[order], cells[order]
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return row[at], np.add.reduceat(cells, at, axis=0)


def _tiles(h: HiCOO, u: DataFrame, k: int, rank: int) -> DataFrame:
    """(b``k``, _u``k``): the tiles of factor ``u`` of mode ``k``."""
    return factor_tiles(u, h.sb_bits, rank, h.ndims[k]).select(F.col("tile").alias(f"b{k}"), F.col("vals").alias(f"_u{k}"))


def _hot(h: HiCOO, k: int) -> DataFrame | None:
    """(b``k``, _of): the tiles of mode ``k`` with more entries than a task should have, and the tasks that these ask for.
    Of n entries, no more than n / A_TASK tiles are."""
    if h.most is not None and h.most <= A_TASK:
        return None
    if h.cells is None:
        by = h.df.groupBy(f"b{k}").agg(F.sum("nnz").alias("_n"))
    else:
        by = h.cells.groupBy(F.shiftright(f"i{k}", h.sb_bits).alias(f"b{k}")).agg(F.count("*").alias("_n"))
    return by.where(F.col("_n") > A_TASK).select(f"b{k}", F.ceil(F.col("_n") / A_TASK).alias("_of"))


def _beside(h: HiCOO, df: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """Blocks, and the tiles of mode ``k`` as rows of their own, each before its blocks: a tile goes to a task once, not once a block.
    Tiles are dealt out by kernel coordinate, as blocks near one another reach the same rows of the result. The blocks of a tile with very
    many entries are spread over as many tasks as these ask for, and the tile goes to each."""
    shares, at, hot = F.lit(1).cast("bigint"), f"b{k}", _hot(h, k)
    if hot is not None:
        df, tiles = (x.join(F.broadcast(hot), at, "left") for x in (df, tiles))
        shares = F.coalesce("_of", shares)
    blocks = df.withColumn("_share", F.pmod(F.xxhash64(*h.blocks), shares))
    rows = blocks.unionByName(tiles.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))), allowMissingColumns=True)
    by = [F.shiftright(at, h.sk_bits - h.sb_bits), "_share"]
    parts = [max(rows.sparkSession.sparkContext.defaultParallelism, -(-h.most // A_STREAM))] if h.most else []
    return rows.repartition(*parts, *by).sortWithinPartitions(at, F.col("elems").isNotNull())


def block_sums(h: HiCOO, blocks: DataFrame, factors: Sequence[DataFrame | None], mode: int, rank: int, once: bool = False, beside: int | None = None) -> DataFrame:
    """(row, s0 ..): sums of the contraction of ``blocks``, rows of ``h``, by the tasks that have them.

    Each block meets one tile of each other factor, broadcast where the sizes allow, and is contracted with it in
    numpy, many blocks at once. The tiles of mode ``beside`` aren't joined: blocks are dealt out by them and read them once
    for all that need them. A task sends a row's sum on when it has too many, or, with ``once``, when it has seen all
    its blocks: then it holds as many rows of sums as it has rows of the result.
    """
    others, sb_bits = [k for k in range(len(h.ndims)) if k != mode], h.sb_bits
    df = blocks.select(*h.blocks, "elems")
    for k in others:
        if k != beside:
            df = df.join(bounded(_tiles(h, factors[k], k, rank), -(-h.ndims[k] // (1 << h.sb_bits)), rank << h.sb_bits), f"b{k}")
    if beside is not None:
        df = _beside(h, df, _tiles(h, factors[beside], beside, rank), beside)
    names = ["row", *(f"s{r}" for r in range(rank))]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, (-1, np.zeros((0, rank)))
        sent = lambda row, sums: pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(np.ascontiguousarray(sums[:, r])) for r in range(rank))], names=names)
        for batch in them:
            sizes = np.diff(batch.column("elems").offsets.to_numpy())
            cut = np.flatnonzero(np.diff((np.cumsum(sizes) * rank) // HELD)) + 1  # where a batch would have too many products
            for lo, hi in zip([0, *cut], [*cut, len(batch)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                found = {k: _joined(part, k, rank) for k in others if k != beside}
                if beside is not None:
                    found[beside], last = _passing(part, beside, rank, last)
                row, cells = _contract(part, mode, found, sb_bits, rank)
                if len(row):
                    held.append((row, cells))
                    n += cells.size
                if n >= HELD:
                    held = [_summed(held)]
                    n = 0 if once else held[0][1].size
                if not once and len(held) == 1 and n >= HELD // 2:
                    yield sent(*held[0])
                    held, n = [], 0
        if held:
            yield sent(*_summed(held))

    kinds = ", ".join(["row bigint", *(f"s{r} double" for r in range(rank))])
    return df.select(*h.blocks, "elems", *(f"_u{k}" for k in others)).mapInArrow(batches, kinds)


def _whole(sums: DataFrame, rank: int) -> DataFrame:
    return sums.select("row", F.array(*(F.col(f"s{r}") for r in range(rank))).alias("vals"))


def _dense(out: DataFrame, rows: int, rank: int) -> DataFrame:
    every = out.sparkSession.range(rows).withColumnRenamed("id", "row")
    return every.join(bounded(out, rows, rank), "row", "left").select("row", F.coalesce("vals", F.array_repeat(F.lit(0.0), rank)).alias("vals"))


def _checked(h: HiCOO, factors: Sequence[DataFrame | None], mode: int) -> None:
    if not 0 <= mode < len(h.ndims):
        raise ShapeMismatchError(f"mode {mode} of {len(h.ndims)}")
    if len(factors) != len(h.ndims):
        raise ShapeMismatchError(f"{len(factors)} factors for {len(h.ndims)} modes")


def hicoo_mttkrp_tiled(h: HiCOO, factors: Sequence[DataFrame | None], mode: int, rank: int, dense: bool = True) -> DataFrame:
    """(row, vals): the contraction block by block, and a task's sums are shuffled, not products. The longest of the other modes has its
    tiles read once a task and tile, however few entries a block has; for each further one a row is joined a block, not an entry."""
    _checked(h, factors, mode)
    longest = max((k for k in range(len(h.ndims)) if k != mode), key=lambda k: h.ndims[k], default=None)
    sums = block_sums(h, h.df, factors, mode, rank, beside=longest).groupBy("row").agg(*(F.sum(f"s{r}").alias(f"s{r}") for r in range(rank)))
    return _dense(_whole(sums, rank), h.ndims[mode], rank) if dense else _whole(sums, rank)


def balanced_schedule(h: HiCOO, mode: int, parts: int) -> DataFrame:
    """(k, part, shares, nnz): each kernel coordinate of ``mode`` with the task that gets it.

    A coordinate of at most a task's even share of the entries goes whole to one task, so that no other one adds to its rows
    (shares 1). One of more is split into as many shares as it has even shares, which start at ``part``; their sums
    are added afterwards. The longest come first and are dealt to the tasks there and back, so that a task gets less
    than its even share and the longest of the whole ones together. The order comes from range partitions; a row a coordinate.
    """
    by = h.df.groupBy(F.col(f"k{mode}").alias("k")).agg(F.sum("nnz").alias("nnz"))
    total = h.df.agg(F.coalesce(F.sum("nnz"), F.lit(0))).first()[0]
    even = max(1, -(-total // parts))
    ranked = with_pos(by.withColumn("shares", F.ceil(F.col("nnz") / even).cast("bigint")), [F.col("nnz").desc(), F.col("k")])
    turn, place = F.floor(F.col("pos") / parts), F.col("pos") % parts
    part = F.when(turn % 2 == 0, place).otherwise(parts - 1 - place)
    return ranked.select("k", part.cast("int").alias("part"), "shares", "nnz")


def scheduled_blocks(h: HiCOO, plan: DataFrame, mode: int, parts: int) -> DataFrame:
    """The blocks of ``h`` with part, the task by ``plan``, and shares; those of a split coordinate are spread over its shares."""
    met = h.df.join(bounded(plan.withColumnRenamed("k", f"k{mode}").drop("nnz"), -(-h.ndims[mode] // (1 << h.sk_bits)), 3), f"k{mode}")
    share = F.pmod(F.xxhash64(*h.blocks), F.col("shares"))
    return met.withColumn("part", F.pmod(F.col("part") + share, F.lit(parts)).cast("int"))


def hicoo_mttkrp_balanced(h: HiCOO, factors: Sequence[DataFrame | None], mode: int, rank: int, parts: int | None = None, dense: bool = True) -> DataFrame:
    """(row, vals): the tiled contraction by ``balanced_schedule``: blocks are dealt out once, to tasks of like numbers of entries.

    Rows of coordinates that are whole in a task are summed there for good, without a shuffle of sums; the split
    coordinates' tasks have sums of their own, which are added afterwards.
    """
    _checked(h, factors, mode)
    parts = parts or int(h.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = balanced_schedule(h, mode, parts)
    blocks = scheduled_blocks(h, plan, mode, parts)
    dealt = lambda of: blocks.where(of).repartitionById(parts, "part")
    sums = block_sums(h, dealt("shares = 1"), factors, mode, rank, once=True)
    if plan.where("shares > 1").limit(1).count():
        split = block_sums(h, dealt("shares > 1"), factors, mode, rank).groupBy("row").agg(*(F.sum(f"s{r}").alias(f"s{r}") for r in range(rank)))
        sums = sums.unionByName(split)
    return _dense(_whole(sums, rank), h.ndims[mode], rank) if dense else _whole(sums, rank)
