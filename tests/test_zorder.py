"""Boxes read from tables in Z-order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError
from tensorloom.sources import zorder
from tensorloom.tensor import SparseTensor


def key(index, bits):
    """Bits of the indices in turn, the first index's first, from the highest."""
    return int("".join(str(i >> b & 1) for b in reversed(range(bits)) for i in index), 2)


@pytest.mark.parametrize("most", [1, 5, 64, 10_000])
def test_ranges_hold_the_box(most):
    r, dims = random.Random(most), (16, 9, 5)
    for _ in range(40):
        low, high = zip(*(sorted((r.randrange(-2, d + 2), r.randrange(-2, d + 3))) for d in dims))
        ranges = zorder.z_ranges(dims, low, high, most)
        assert len(ranges) <= most and all(a <= b for a, b in ranges)
        got = {c for c in itertools.product(*map(range, dims)) if any(a <= key(c, 4) <= b for a, b in ranges)}
        box = {c for c in itertools.product(*map(range, dims)) if all(a <= i < b for i, a, b in zip(c, low, high))}
        assert got >= box
        if most == 10_000:
            assert got == box


def rows_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_small_box_reads_few_rows(spark, tmp_path):
    n = 400_000
    index = lambda seed, d: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(d))
    dims = (1000, 2000, 500)
    x = SparseTensor(spark.range(n).select(*(index(k, d).alias(f"i{k}") for k, d in enumerate(dims)), F.lit(1.0).alias("v")), dims).coalesce_duplicates()
    zorder.write_zordered(x, f"{tmp_path}/z")
    low, high = (500, 1100, 200), (600, 1300, 250)
    box = zorder.read_box(spark, f"{tmp_path}/z", dims, low, high)
    want = x.df.where("i0 >= 500 AND i0 < 600 AND i1 >= 1100 AND i1 < 1300 AND i2 >= 200 AND i2 < 250")
    assert box.entries() == sorted(map(tuple, want.collect())) and box.nnz > 200
    read = rows_read(box.df)
    print("rows read", read)
    assert read < n / 10


def test_large_indices_and_odd_boxes(spark, tmp_path):
    dims = (2**40, 2**35, 7)
    x = SparseTensor.from_rows(spark, [(2**39 + k, 2**34 - k, k % 7, k) for k in range(50)] + [(0, 0, 0, -1)], dims)
    zorder.write_zordered(x, f"{tmp_path}/z", 3)
    read = lambda low, high: zorder.read_box(spark, f"{tmp_path}/z", dims, low, high).entries()
    assert read((0, 0, 0), dims) == x.entries()
    assert read((2**39 + 3, 0, 0), (2**39 + 9, 2**35, 7)) == [(2**39 + k, 2**34 - k, k % 7, float(k)) for k in range(3, 9)]
    assert read((5, 5, 5), (5, 9, 9)) == [] and read((-9, -9, -9), (1, 1, 1)) == [(0, 0, 0, -1.0)]
    with pytest.raises(ShapeMismatchError):
        read((0,), (1,))
