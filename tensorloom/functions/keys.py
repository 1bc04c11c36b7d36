"""Ordering keys and mode orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError


def morton(indices: Sequence[Column], bits: int) -> list[Column]:
    """Z-order key of ``bits`` bits an index, the first index most significant: bigints of 62 bits, high first."""
    n = len(indices)
    if not 1 <= bits <= 62:
        raise TensorValueError("1 to 62 bits an index")
    total = n * bits
    words = [F.lit(0).cast("bigint") for _ in range(-(-total // 62))]
    for b in range(bits):
        for k, i in enumerate(indices):
            at = b * n + (n - 1 - k)
            word = len(words) - 1 - at // 62
            words[word] = words[word].bitwiseOR(F.shiftleft(F.shiftright(i.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), at % 62))
    return words


def best_mode_order(ndims: Sequence[int], mode: int) -> list[int]:
    """``mode`` first, the others by increasing size."""
    return [mode, *sorted((k for k in range(len(ndims)) if k != mode), key=lambda k: (ndims[k], k))]


def worst_mode_order(ndims: Sequence[int], mode: int) -> list[int]:
    """The others by decreasing size, ``mode`` last."""
    return [*sorted((k for k in range(len(ndims)) if k != mode), key=lambda k: (-ndims[k], k)), mode]


def compare(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """-1, 0 or 1: lexicographic order of coordinates."""
    a, b = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(left))), F.struct(*(c.alias(f"c{k}") for k, c in enumerate(right)))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
