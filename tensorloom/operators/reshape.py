"""Slices, matricization, semi-sparse and other formats, relabelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.operators.positions import with_pos
from tensorloom.tensor import SemiSparseTensor, SparseTensor, bounded, mode_names


def subtensor(x: SparseTensor, low: Sequence[int], high: Sequence[int]) -> SparseTensor:
    """Entries with low <= index < high in every mode; indices and sizes stay. The ranges reach the scan."""
    keep = F.lit(True)
    for m, lo, hi in zip(x.modes, low, high, strict=True):
        keep = keep & (F.col(m) >= lo) & (F.col(m) < hi)
    return x.with_df(x.df.where(keep), x.sortorder)


def matricize(x: SparseTensor, mode: int, transpose: int = 1) -> DataFrame:
    """(row, col, v): ``mode`` against the others in the order mode+1, mode+2, ..., the last fastest.

    transpose 1: ``mode`` is the row; 0: the column.
    """
    x.check_mode(mode)
    if transpose not in (0, 1):
        raise TensorValueError("transpose is 0 or 1")
    order = [(mode + k) % x.nmodes for k in range(1, x.nmodes)]
    other, stride = F.lit(0).cast("bigint"), 1
    for k in reversed(order):
        other, stride = other + F.col(f"i{k}") * F.lit(stride).cast("bigint"), stride * x.ndims[k]
    if stride > 2**63 - 1:
        raise ShapeMismatchError("the other modes have more than 2^63 cells")
    own = F.col(f"i{mode}")
    row, col = (own, other) if transpose else (other, own)
    return x.df.select(row.alias("row"), col.alias("col"), "v")


def dense_fiber(entries: str, n: int) -> Column:
    """The array of n values from ``entries``, a column of (k, v) structs sorted by k: zeros fill the gaps."""
    e = F.col(entries)
    zeros = lambda count: F.array_repeat(F.lit(0.0), count.cast("int"))
    before = lambda i: F.coalesce(F.get(e, i - 1)["k"], F.lit(-1).cast("bigint"))
    filled = F.flatten(F.transform(e, lambda x, i: F.concat(zeros(x["k"] - before(i) - 1), F.array(x["v"]))))
    return F.concat(filled, zeros(F.lit(n - 1) - before(F.size(e))))


def to_semisparse(x: SparseTensor, mode: int) -> SemiSparseTensor:
    """``mode`` as a dense fiber; entries with equal coordinates are summed."""
    x.check_mode(mode)
    rest = x.rest(mode)
    cells = x.df.groupBy(*rest, f"i{mode}").agg(F.sum("v").alias("v"))
    fibers = cells.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(F.col(f"i{mode}").alias("k"), "v"))).alias("at"))
    return SemiSparseTensor(fibers.select(*rest, dense_fiber("at", x.ndims[mode]).alias("fiber")), x.ndims, mode)


def from_semisparse(y: SemiSparseTensor, epsilon: float = 1e-6) -> SparseTensor:
    """Entries of the fibers that are NaN, infinite, or at least ``epsilon`` (> 0) in magnitude."""
    if epsilon <= 0:
        raise TensorValueError("epsilon must be positive")
    cells = y.df.select(*y.rest, F.posexplode("fiber").alias("_k", "v")).where(F.isnan("v") | (F.abs("v") >= epsilon))
    return SparseTensor(cells.withColumn(f"i{y.mode}", F.col("_k").cast("bigint")).drop("_k"), y.ndims)


def set_mode(y: SemiSparseTensor, mode: int, epsilon: float = 5e-324) -> SemiSparseTensor:
    """Another mode as the dense one."""
    return y if mode == y.mode else to_semisparse(from_semisparse(y, epsilon), mode)


def merge_fibers(y: SemiSparseTensor) -> SemiSparseTensor:
    """Fibers with equal coordinates added, position by position."""
    cells = y.df.select(*y.rest, F.posexplode("fiber").alias("_k", "v")).groupBy(*y.rest, "_k").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*y.rest).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "v"))), lambda s: s["v"]).alias("fiber"))
    return SemiSparseTensor(whole, y.ndims, y.mode)


def append(y: SemiSparseTensor, entries: DataFrame) -> SemiSparseTensor:
    """Insert or replace single elements: ``entries`` has all modes, v and a number ``seq``; the last counts."""
    modes = mode_names(len(y.ndims))
    old = y.df.select(*y.rest, F.posexplode("fiber").alias("_k", "v")).select(*(F.col("_k").cast("bigint").alias(m) if m not in y.rest else F.col(m) for m in modes), "v", F.lit(None).cast("bigint").alias("seq"))
    last = old.unionByName(entries.select(*modes, "v", F.col("seq").cast("bigint"))).groupBy(*modes).agg(F.max_by("v", F.coalesce("seq", F.lit(-(2**62)))).alias("v"))
    return to_semisparse(SparseTensor(last, y.ndims), y.mode)


def fiber_index(x: SparseTensor, mode: int) -> DataFrame:
    """(rest modes, nnz, pos, fiberidx): the fibers of ``mode``, in order, with their first entry's position."""
    x.check_mode(mode)
    rest = x.rest(mode)
    return with_pos(x.df.groupBy(*rest).agg(F.count("*").alias("nnz")), rest, {"fiberidx": "nnz"})


def to_csr(y: SemiSparseTensor) -> DataFrame:
    """(row, rowptr, cols, vals): a row a fiber, in order, with all columns."""
    n = y.ndims[y.mode]
    ranked = with_pos(y.df, y.rest).withColumn("rowptr", F.col("pos") * n)
    return ranked.select(F.col("pos").alias("row"), "rowptr", F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")).alias("cols"), F.col("fiber").alias("vals"))


def to_dense(x: SparseTensor) -> DataFrame:
    """(row, vals): a two-mode tensor as a dense matrix; of equal coordinates the largest value."""
    if x.nmodes != 2:
        raise ShapeMismatchError("a matrix has two modes")
    cells = x.df.groupBy("i0", "i1").agg(F.max("v").alias("v"))
    rows = cells.groupBy("i0").agg(F.sort_array(F.collect_list(F.struct(F.col("i1").alias("k"), "v"))).alias("at"))
    every = x.df.sparkSession.range(x.ndims[0]).withColumnRenamed("id", "row")
    zero = F.array_repeat(F.lit(0.0), x.ndims[1])
    return every.join(rows, F.col("row") == F.col("i0"), "left").select("row", F.when(F.col("at").isNull(), zero).otherwise(dense_fiber("at", x.ndims[1])).alias("vals"))


def relabel(x: SparseTensor, maps: DataFrame) -> SparseTensor:
    """New indices by ``maps`` (mode, old, new), which covers every index used."""
    df = x.df
    for k, m in enumerate(x.modes):
        one = bounded(maps.where(F.col("mode") == k).select(F.col("old").alias(m), F.col("new").alias("_new")), x.ndims[k], 2)
        df = df.join(one, m).drop(m).withColumnRenamed("_new", m)
    return x.with_df(df)


def invert_map(maps: DataFrame) -> DataFrame:
    return maps.select("mode", F.col("new").alias("old"), F.col("old").alias("new"))


def crop(x: SparseTensor, slices: Sequence[str]) -> SparseTensor:
    """1-based slices, one a mode: ``B:E``, ``B:``, ``:E``, ``I``, ``:``, or ``-`` to drop the mode.

    Entries that then coincide are summed; zeros are dropped.
    """
    if len(slices) != x.nmodes:
        raise ShapeMismatchError(f"{len(slices)} slices for {x.nmodes} modes")
    keep, left = F.lit(True), []
    for k, s in enumerate(slices):
        i = F.col(f"i{k}") + 1
        if s != "-":
            left.append(k)
        if s in ("-", ":"):
            continue
        lo, colon, hi = s.partition(":")
        try:
            keep = keep & ((i == int(lo)) if not colon else (i >= int(lo or 1)) & (i < int(hi or 2**62)))
        except ValueError as e:
            raise TensorValueError(f"slice {s!r}") from e
    return _projected(x.df.where(keep), [(F.col(f"i{k}"), x.ndims[k]) for k in left])


def _projected(df: DataFrame, modes: list[tuple[Column, int]]) -> SparseTensor:
    names = mode_names(len(modes))
    summed = df.select(*(c.alias(n) for n, (c, _) in zip(names, modes)), "v").groupBy(*names).agg(F.sum("v").alias("v")).where("v <> 0")
    return SparseTensor(summed, tuple(d for _, d in modes))


def reindex(x: SparseTensor) -> SparseTensor:
    """Used indices renumbered from 0 in order, modes with one index dropped, coinciding entries summed."""
    df, modes = x.df, []
    for k, m in enumerate(x.modes):
        ranks = with_pos(df.select(m).distinct(), [m]).select(m, F.col("pos").alias(f"_{m}"))
        n = ranks.count()
        if n > 1:
            modes.append((F.col(f"_{m}"), n))
            df = df.join(bounded(ranks, n, 2), m)
    return _projected(df, modes)


#: Bits of an index that a round of ``nth_entry`` looks at: 1024 counts at most.
ROUND_BITS = 10


def nth_entry(x: SparseTensor, n: int) -> DataFrame:
    """The n-th entry, from 0, in lexicographic order, ties by value; no row if there is none.

    Found by counting, without a sort: mode by mode, from the high bits of the index on, a round counts the entries by
    the next ``ROUND_BITS`` bits among those that agree with what is known so far, and goes on where the n-th lies.
    """
    if n < 0:
        raise TensorValueError(f"entry {n}")
    rest = x.df
    for m, d in zip(x.modes, x.ndims):
        known, width = 0, max(1, d - 1).bit_length()
        while width:
            low = max(0, width - ROUND_BITS)
            counts = rest.where(F.shiftright(m, width) == known).groupBy(F.shiftright(m, low).alias("part")).agg(F.count("*").alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["part"]):
                if n < r["n"]:
                    known, width = r["part"], low
                    break
                n -= r["n"]
            else:
                return rest.limit(0)
        rest = rest.where(F.col(m) == known)
    return rest.orderBy("v").offset(n).limit(1)  # of equal coordinates


def nth(x: SparseTensor, n: int) -> tuple | None:
    """The n-th entry, from 0, in lexicographic order."""
    found = nth_entry(x, n).collect()
    return tuple(found[0]) if found else None
