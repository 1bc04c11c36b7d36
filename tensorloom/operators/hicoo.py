"""The blocked format: kernels of 2^sk, blocks of 2^sb, elements as small offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError
from tensorloom.functions.keys import morton
from tensorloom.operators.positions import with_pos
from tensorloom.operators.products import mttkrp
from tensorloom.storage import materialize
from tensorloom.tensor import SparseTensor, bounded, mode_names, tasks_of

#: Bits of the number of entries in completed blocks at which a chunk ends.
CHUNK_BITS = 14


@dataclass
class HiCOO:
    """``df``: a row a block: k0.., b0.. (kernel and block coordinates), nnz, elems (offsets e0.. and v)."""

    df: DataFrame
    ndims: tuple[int, ...]
    sb_bits: int
    sk_bits: int
    #: No more entries, so no more blocks and kernels than that, if it is known.
    most: int | None = None
    #: Rows with the coordinates i0.. of the entries, if they are known, some perhaps more than once: for counts without making blocks.
    cells: DataFrame | None = None

    @property
    def kernels(self) -> list[str]:
        return [f"k{m}" for m in range(len(self.ndims))]

    @property
    def blocks(self) -> list[str]:
        return [f"b{m}" for m in range(len(self.ndims))]


def to_hicoo(x: SparseTensor, sb_bits: int = 7, sk_bits: int = 10) -> HiCOO:
    """One aggregate by block; offsets fit smallints. A block holds at most 2^(sb_bits * modes) entries."""
    if not 1 <= sb_bits <= 15 or sk_bits < sb_bits or sb_bits > CHUNK_BITS:
        raise TensorValueError(f"sb_bits {sb_bits}, sk_bits {sk_bits}")
    n, low = x.nmodes, F.lit((1 << sb_bits) - 1).cast("bigint")
    offsets = F.struct(*(F.col(m).bitwiseAND(low).cast("smallint").alias(f"e{k}") for k, m in enumerate(x.modes)), "v")
    keys = [F.shiftright(m, sk_bits).alias(f"k{k}") for k, m in enumerate(x.modes)] + [F.col(f"_d{k}").alias(f"b{k}") for k in range(n)]
    names = [f"k{k}" for k in range(n)] + [f"b{k}" for k in range(n)]
    dealt = x.dealt([F.shiftright(m, sb_bits) for m in x.modes])  # of distinct entries a block can't be too large for a task
    df = dealt.select(*keys, offsets.alias("e")).groupBy(*names).agg(F.count("*").alias("nnz"), F.sort_array(F.collect_list("e")).alias("elems"))
    return HiCOO(df, x.ndims, sb_bits, sk_bits, x.most, x.rows[0] if x.rows else x.df)


def entries(h: HiCOO, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, i0.., v): the entries, with kernel coordinates as further columns."""
    cells = h.df.select(*keep, *h.blocks, F.explode("elems").alias("e"))
    cols = [(F.shiftleft(b, h.sb_bits) + F.col(f"e.e{k}")).alias(m) for k, (b, m) in enumerate(zip(h.blocks, mode_names(len(h.ndims))))]
    return cells.select(*keep, *cols, F.col("e.v").alias("v"))


def to_coo(h: HiCOO) -> SparseTensor:
    return SparseTensor(entries(h), h.ndims)


def kernel_pointers(h: HiCOO) -> DataFrame:
    """(k0.., kid, nnz, kptr, blocks): kernels in order, with their first entry's position."""
    kernels = _dealt(h.df.drop("elems"), h, h.kernels).groupBy(*h.kernels).agg(F.sum("nnz").alias("nnz"), F.count("*").alias("blocks"))
    return with_pos(kernels, h.kernels, {"kptr": "nnz"}, rows=h.most).withColumnRenamed("pos", "kid")


def _dealt(df: DataFrame, h: HiCOO, by: list[str]) -> DataFrame:
    """Rows of ``h``'s blocks or kernels dealt out by ``by``, to as many tasks as the known number of its entries asks for."""
    return df.repartition(tasks_of(h.most), *by) if h.most and tasks_of(h.most) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def block_pointers(h: HiCOO) -> DataFrame:
    """(kid, bid, b0.., nnz, bptr): blocks by kernel and within a kernel in Z-order, with their first entry's position."""
    width = max(1, max((d - 1) >> h.sb_bits for d in h.ndims).bit_length())
    ranked = with_pos(h.df.drop("elems"), [*map(F.col, h.kernels), *morton([F.col(b) for b in h.blocks], width)], {"bptr": "nnz"}, {"kid": h.kernels}, h.most)
    return ranked.select("kid", F.col("pos").alias("bid"), *h.blocks, "nnz", "bptr")


def chunk_pointers(h: HiCOO, bits: int = CHUNK_BITS) -> DataFrame:
    """(kid, cid, first_block): a chunk starts with every kernel, and after blocks with 2^bits entries or more.

    Kernels are dealt out and their blocks read in order; a task knows no more than the batch that it reads, the
    kernel it is in and how much its last chunk holds.
    """
    full = 1 << bits

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, chunk, have = None, -1, 0
        for batch in them:
            kid, bid, nnz = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kid", "bid", "nnz"))
            before, out = np.concatenate([[0], np.cumsum(nnz)]), []
            starts = np.flatnonzero(np.append(True, kid[1:] != kid[:-1])) if len(kid) else np.zeros(0, np.int64)
            for lo, hi in zip(starts, [*starts[1:], len(kid)]):
                at = int(lo)
                if kid[lo] == kernel:  # the kernel goes on: where does its open chunk end?
                    at = max(at, int(np.searchsorted(before[: hi + 1], before[lo] + full - have)))
                    have += int(before[min(at, hi)] - before[lo])
                else:
                    kernel, chunk, have = kid[lo], -1, 0
                while at < hi:
                    chunk += 1
                    out.append((kernel, chunk, bid[at]))
                    end = int(np.searchsorted(before[: hi + 1], before[at] + full))
                    have = int(before[min(end, hi)] - before[at])
                    at = end
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["kid", "cid", "first_block"])

    blocks = _dealt(block_pointers(h).select("kid", "bid", "nnz"), h, ["kid"]).sortWithinPartitions("kid", "bid")
    return blocks.mapInArrow(batches, "kid bigint, cid int, first_block bigint")


def schedule(h: HiCOO) -> DataFrame:
    """(mode, k, place, kid): the kernels that share a coordinate, numbered; a row a kernel and mode."""
    rows = kernel_pointers(h).select("kid", F.posexplode(F.array(*h.kernels)).alias("mode", "k"))
    placed = with_pos(rows, ["mode", "k", "kid"], rows=h.most and h.most * len(h.ndims))
    starts = placed.groupBy("mode", "k").agg(F.min("pos").alias("start"))
    return placed.join(bounded(starts, sum(-(-d // (1 << h.sk_bits)) for d in h.ndims), 3), ["mode", "k"]).select("mode", "k", (F.col("pos") - F.col("start")).alias("place"), "kid")


#: Bytes of a value, an element's offset, a block's coordinate, a pointer into the entries and an index in the format.
VALUE_BYTES, OFFSET_BYTES, BLOCK_BYTES, POINTER_BYTES, INDEX_BYTES = 4, 1, 4, 8, 4


def status(h: HiCOO) -> DataFrame:
    """A row: blocks, kernels, chunks, entries; most, least, average (floored), median and geometric mean of a block;
    alpha; bytes of the format; for each mode the kernel coordinates (kdim) and the most kernels that share one (kiters).
    """
    side, n = float(1 << h.sb_bits), len(h.ndims)
    h = replace(h, df=materialize(h.df.drop("elems"), "blocks"))
    of_blocks = h.df.agg(
        F.count("*").alias("nb"), F.sum("nnz").alias("nnz"), F.max("nnz").alias("max_nnzb"), F.min("nnz").alias("min_nnzb"),
        F.floor(F.sum("nnz") / F.count("*")).alias("avg_nnzb"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY nnz)").cast("bigint").alias("median_nnzb"),
        F.round(F.exp(F.avg(F.log(F.col("nnz") / side))), 6).alias("geo_mean"), F.round(F.count("*") / F.sum("nnz"), 6).alias("alpha_b"),
    )
    chunks = chunk_pointers(h).agg(F.count("*").alias("nc"))
    kernels = _dealt(h.df.select(*h.kernels), h, h.kernels).distinct().select(F.posexplode(F.array(*h.kernels)).alias("mode", "k"))
    of_mode = lambda m: F.when(F.col("mode") == m, F.col("n"))
    shared = kernels.groupBy("mode", "k").agg(F.count("*").alias("n")).groupBy().agg(F.coalesce(F.sum(of_mode(0)), F.lit(0)).alias("nk"), *(F.max(of_mode(m)).alias(f"kiters{m}") for m in range(n)))
    kdim = [-(-d // (1 << h.sk_bits)) for d in h.ndims]
    entries = F.col("nnz") * (VALUE_BYTES + n * OFFSET_BYTES) + F.col("nb") * n * BLOCK_BYTES
    pointers = (F.col("nb") + F.col("nk") + F.col("nc") + 3) * POINTER_BYTES
    scheduled = F.col("nk") * n * INDEX_BYTES + (sum(kdim) + n) * 8 + n * INDEX_BYTES
    whole = of_blocks.crossJoin(chunks).crossJoin(shared)  # a row each
    first = ["nb", "nk", *(c for c in of_blocks.columns if c != "nb"), "nc", *(f"kiters{m}" for m in range(n))]
    return whole.select(*first, (entries + pointers + scheduled).alias("bytes"), *(F.lit(d).cast("bigint").alias(f"kdim{m}") for m, d in enumerate(kdim)))


def norm_squared_df(h: HiCOO) -> DataFrame:
    return h.df.agg(F.coalesce(F.sum(F.aggregate("elems", F.lit(0.0), lambda a, e: a + e["v"] * e["v"])), F.lit(0.0)).alias("norm_sq"))


def hicoo_mttkrp(h: HiCOO, factors, mode: int, rank: int, dense: bool = True) -> DataFrame:
    """The same contraction from blocks: their elements are unpacked in place, before the first join."""
    return mttkrp(to_coo(h), factors, mode, rank, dense)


def hicoo_mttkrp_scheduled(h: HiCOO, factors, mode: int, rank: int, dense: bool = True) -> DataFrame:
    """From blocks dealt out by the kernel coordinate of ``mode``: all that adds to one output row meets in a task.

    Sums are grouped by that coordinate and the row, which the dealing satisfies: the blocks are shuffled once,
    packed, and no sums are.
    """
    parts = int(h.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = HiCOO(h.df.repartition(parts, f"k{mode}"), h.ndims, h.sb_bits, h.sk_bits)
    return mttkrp(to_coo(h), factors, mode, rank, dense, dealt=entries(dealt, (f"k{mode}",)), by=(f"k{mode}",))


def block_end(first: int, sb_bits: int, dim: int) -> int:
    """The end, exclusive, of the block that starts at ``first``."""
    return min(first + (1 << sb_bits), dim)
