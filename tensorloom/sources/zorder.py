"""Tables of entries in Z-order, from which a box is read by ranges of the order's keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.errors import ShapeMismatchError
from tensorloom.functions.keys import morton
from tensorloom.operators.reshape import subtensor
from tensorloom.tensor import SparseTensor, mode_names, schema

#: Ranges into which a box is divided. What further division would cut off is read and left out by its indices.
MOST_RANGES = 64
#: Rows of a Parquet page: what a reader skips by the table's statistics.
PAGE_ROWS = 4096


def _bits(ndims: Sequence[int]) -> tuple[int, int]:
    """(bits of an index in the key, lowest bits left out): keys have 62 bits."""
    need = max(1, *((d - 1).bit_length() for d in ndims))
    kept = min(need, 62 // len(ndims))
    return kept, need - kept


def z_key(ndims: Sequence[int]) -> Column:
    """The Z-order key of an entry; of large tensors that of a coarser grid, whose cells hold several coordinates."""
    bits, coarse = _bits(ndims)
    return morton([F.shiftright(m, coarse) for m in mode_names(len(ndims))], bits)[0]


def write_zordered(x: SparseTensor, path: str, parts: int | None = None) -> None:
    """Writes the entries and their key z as Parquet, range-partitioned and sorted by it. An existing table is replaced."""
    order = ["z", *x.modes]
    parts = parts or int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = x.df.withColumn("z", z_key(x.ndims))
    keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def z_ranges(ndims: Sequence[int], low: Sequence[int], high: Sequence[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, ends included, that hold all entries with low <= index < high in every mode: ``most`` at most.

    Halves of the grid, by the key's bits from the highest, are kept if inside the box, dropped if outside and
    divided if across its border, all of one size at a time, as long as there are few enough.
    """
    n = len(ndims)
    bits, coarse = _bits(ndims)
    lo = [max(0, a) >> coarse for a in low]
    hi = [(min(b, d) - 1) >> coarse if min(b, d) > max(0, a) else -1 for a, b, d in zip(low, high, ndims, strict=True)]
    if any(h < a for a, h in zip(lo, hi)):
        return []
    inside: list[tuple[int, int]] = []
    across = [(0, [0] * n)]  # (key, lowest index of each mode)
    for at in reversed(range(n * bits)):
        mode, bit = n - 1 - at % n, at // n  # the key's bit ``at`` is this bit of this mode's index
        width = [1 << bit if m <= mode else 1 << (bit + 1) for m in range(n)]
        finer, whole = [], []
        for key, first in across:
            for half in (0, 1):
                start = [f + (half << bit) if m == mode else f for m, f in enumerate(first)]
                ends = [s + w - 1 for s, w in zip(start, width)]
                if all(s <= h and e >= a for s, e, a, h in zip(start, ends, lo, hi)):
                    within = all(a <= s and e <= h for s, e, a, h in zip(start, ends, lo, hi))
                    (whole if within else finer).append((key | half << at, start))
        if len(inside) + len(whole) + len(finer) > most:
            inside += [(key, key + (2 << at) - 1) for key, _ in across]
            across = []
            break
        inside += [(key, key + (1 << at) - 1) for key, _ in whole]
        across = finer
    inside += [(key, key) for key, _ in across]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(inside):
        if merged and merged[-1][1] + 1 == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def read_box(spark: SparkSession, path: str, ndims: Sequence[int], low: Sequence[int], high: Sequence[int]) -> SparseTensor:
    """The entries with low <= index < high in every mode of a table that ``write_zordered`` wrote; sizes stay.

    The ranges of keys and the box's sides reach the scan, which skips files, row groups and pages by their statistics.
    """
    if not len(ndims) == len(low) == len(high):
        raise ShapeMismatchError("a box has a low and a high end for each mode")
    table = spark.read.schema(schema(len(ndims)).add("z", T.LongType())).parquet(path)
    ranges = [(F.col("z") >= a) & (F.col("z") <= b) for a, b in z_ranges(ndims, low, high)]
    found = table.where(reduce(lambda p, q: p | q, ranges) if ranges else F.lit(False)).drop("z")
    return subtensor(SparseTensor(found, tuple(ndims)), low, high)
