"""Joins of coordinates by range (points in boxes, intervals that overlap, last entry before) and windows along a mode.

None is a cross join, and none gives a key, fiber or coordinate to one task for being frequent: boxes meet points in
cells, fibers are cut into bins with halos, and as-of joins carry one row from a range partition to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.storage import materialize
from tensorloom.tensor import SparseTensor

#: Combinations of levels for which a point is put into a cell; with more, levels are rounded up. At least 2^CELL_SIDES.
MOST_LEVELS = 64
#: Steps that levels may be rounded up by, and how much larger the boxes' cells may become altogether by it.
STEPS, MOST_AREA = (4, 2), 3
#: Sides by which cells are made; further ones are compared only.
CELL_SIDES = 3
#: Least width of a bin of a fiber. A bin is at least four times its halo, which so adds a quarter at most.
BIN = 4096


def _distinct_names(left: DataFrame, right: DataFrame) -> None:
    if both := {*left.columns} & {*right.columns}:
        raise ShapeMismatchError(f"columns of both sides: {sorted(both)}")


def _coarser(found: Mapping[tuple[int, ...], int]) -> tuple[list[tuple[int, ...]], tuple[int, ...], int]:
    """The combinations of levels that boxes get, the highest level a side, and the step: levels are rounded up to the highest
    less a multiple of it.

    A point is sent once for each combination, so the step is the largest of STEPS by which the boxes' cells together
    are at most MOST_AREA times as large, and larger still if MOST_LEVELS asks for it.
    """
    tops = tuple(map(max, zip(*found)))
    raised = lambda c, step: tuple(top - (top - x) // step * step for x, top in zip(c, tops))
    area = lambda step: sum(n << sum(raised(c, step)) for c, n in found.items())
    step = next((s for s in STEPS if area(s) <= MOST_AREA * area(1)), 1)
    while len({raised(c, step) for c in found}) > MOST_LEVELS:
        step *= 2
    return sorted({raised(c, step) for c in found}), tops, step


def within(points: DataFrame, boxes: DataFrame, sides: Sequence[tuple[str, str, str]], keys: Sequence[tuple[str, str]] = (), fine: int = 1) -> DataFrame:
    """Each pair of a point and a box that holds it: for all (column, low, high) of ``sides`` low <= column <= high, and
    for all (column, column) of ``keys`` equality. All columns of both.

    Coordinates and bounds are integers of magnitude below 2^62. A box is put into the cells it meets on a grid of cells ``fine`` levels
    smaller than it, or coarser ones (at most 2^fine + 1 a side), a point into one cell for each combination of levels that
    boxes get (``_coarser``), if it is within the bounds of all boxes together; they meet by equality of the cells, in one cell at most, and are compared then. Boxes with low > high hold nothing;
    neither do nulls in bounds, coordinates or keys. Repeated rows give repeated pairs.
    """
    if not sides:
        raise TensorValueError("a box has a side at least")
    _distinct_names(points, boxes)
    spans = [(lo, hi) for _, lo, hi in sides]
    valid = F.lit(True)
    for lo, hi in spans:
        valid = valid & (F.col(lo) <= F.col(hi))
    n = min(len(sides), CELL_SIDES)
    length = lambda lo, hi: F.when(F.col(lo) == F.col(hi), 0).otherwise(F.length(F.bin(F.col(hi) - F.col(lo))))
    boxed = boxes.where(valid).select("*", *(F.greatest(length(lo, hi) - fine, F.lit(0)).alias(f"_l{k}") for k, (lo, hi) in enumerate(spans[:n])))
    ends = [f(F.col(c).cast("bigint")).alias(f"_{x}{k}") for k, span in enumerate(spans) for x, f, c in zip("ab", (F.min, F.max), span)]
    groups = boxed.groupBy(*(f"_l{k}" for k in range(n))).agg(F.count("*").alias("_n"), *ends).collect()  # 64^n rows at most
    if not groups:
        return points.join(boxes, F.lit(False))
    combos, tops, step = _coarser({tuple(r[f"_l{k}"] for k in range(n)): r["_n"] for r in groups})
    for k, (lo, hi) in enumerate(spans[:n]):
        boxed = boxed.withColumn(f"_l{k}", (F.lit(tops[k]) - F.floor((F.lit(tops[k]) - F.col(f"_l{k}")) / step) * step).cast("int"))
        boxed = boxed.withColumn(f"_c{k}", F.explode(F.expr(f"sequence(shiftright(CAST(`{lo}` AS BIGINT), _l{k}), shiftright(CAST(`{hi}` AS BIGINT), _l{k}))")))
    cells = F.array(*(F.struct(*(F.lit(x).alias(f"_m{k}") for k, x in enumerate(c)), *(F.shiftright(F.col(sides[k][0]).cast("bigint"), x).alias(f"_d{k}") for k, x in enumerate(c))) for c in combos))
    known = points.dropna(subset=[c for c, _, _ in sides] + [a for a, _ in keys])
    for k, (c, _, _) in enumerate(sides):  # points outside of all boxes go nowhere
        known = known.where(F.col(c).between(min(r[f"_a{k}"] for r in groups), max(r[f"_b{k}"] for r in groups)))
    placed = known.select("*", F.explode(cells).alias("_cell")).select("*", "_cell.*").drop("_cell")
    on = F.lit(True)
    for k in range(n):
        on = on & (F.col(f"_l{k}") == F.col(f"_m{k}")) & (F.col(f"_c{k}") == F.col(f"_d{k}"))
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    for c, lo, hi in sides:
        on = on & (F.col(c) >= F.col(lo)) & (F.col(c) <= F.col(hi))
    # Sizes are estimated before rows become several: by them a large side could be sent whole to every task.
    return placed.join(boxed.hint("merge"), on).select(*points.columns, *boxes.columns)


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Each pair of intervals, ends included, that share a point, and whose ``keys`` are equal. All columns of both.

    Either the right one starts in the left one, or the left one starts in the right one behind its start: two joins of
    starts with intervals, which have no pair in common. Empty intervals (low > high) and nulls overlap nothing.
    """
    _distinct_names(left, right)
    (alo, ahi), (blo, bhi) = left_span, right_span
    a, b = left.where(F.col(alo) <= F.col(ahi)), right.where(F.col(blo) <= F.col(bhi))
    columns = [*left.columns, *right.columns]
    first = within(b, a, [(blo, alo, ahi)], [(y, x) for x, y in keys])
    after = within(a, b.withColumn("_after", F.col(blo) + 1), [(alo, "_after", bhi)], keys)
    return first.select(*columns).unionByName(after.select(*columns))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], strict: bool = False, into: str = "last") -> DataFrame:
    """``left`` plus ``into``: a struct of ``at`` and ``carry`` of the last row of ``right`` with equal ``keys`` and an
    ``at`` that isn't after (``strict``: that is before) the left row's; null if there is none.

    Of right rows at one place that with the greatest ``carry`` counts. Rows of ``right`` with a null key or place are
    nobody's last; rows of ``left`` with one find none. Repeated left rows stay.

    Both sides are sorted together into range partitions, written once. Within a partition a window finds the last
    row; what comes before a partition is the greatest right row of all earlier ones, a row a partition.
    """
    if into in left.columns:
        raise ShapeMismatchError(f"{into} is a column already")
    ks = [f"_k{k}" for k in range(len(keys))]
    found = F.struct(at, *carry)
    of_left = left.select(*(F.col(c).alias(k) for k, c in zip(ks, keys)), F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_s"), F.struct("*").alias("_row"))
    of_right = right.dropna(subset=[*keys, at]).select(*(F.col(c).alias(k) for k, c in zip(ks, keys)), F.col(at).alias("_t"), F.lit(1 if strict else 0).alias("_s"), found.alias("_c"))
    both = of_left.unionByName(of_right, allowMissingColumns=True)
    order = [*ks, "_t", "_s", "_c"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = [*order, F.xxhash64(F.to_json("_row"))]  # left rows at one place may fill several partitions
    ranked = materialize(both.repartitionByRange(parts, *split).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "asof")

    so_far = Window.partitionBy("_p", *ks).orderBy("_t", "_s", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.select("*", F.last("_c", ignorenulls=True).over(so_far).alias("_in")).where(F.col("_row").isNotNull())
    greatest = F.max(F.when(F.col("_c").isNotNull(), F.struct(*ks, "_t", "_c")))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    edges = ranked.groupBy("_p").agg(greatest.alias("_g")).select("_p", F.max("_g").over(earlier).alias("_g"))
    same = F.col("_t").isNotNull()
    for k in ks:
        same = same & (F.col(k) == F.col(f"_g.{k}"))
    out = inside.join(F.broadcast(edges), "_p")
    return out.select("_row.*", F.coalesce("_in", F.when(same, F.col("_g._c"))).alias(into))


def previous(x: SparseTensor, mode: int, into: str = "last") -> DataFrame:
    """The entries plus ``into``: index along ``mode`` and value of the entry before in the same fiber; null for a fiber's first."""
    x.check_mode(mode)
    return as_of(x.df, x.df, x.rest(mode), f"i{mode}", ["v"], strict=True, into=into)


def moving(x: SparseTensor, mode: int, before: int, after: int = 0, aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """The entries plus, for each of ``aggregates`` (new column: aggregate; by default total, the sum of v), its value over the
    entries of the same fiber whose index along ``mode`` is ``before`` less to ``after`` more than theirs.

    Absent entries count for nothing. A fiber is cut into bins, entries near a bin's end go to the next one too, so a
    group of the window has no more indices than a bin and its halos, however long the fiber.
    """
    x.check_mode(mode)
    if before < 0 or after < 0:
        raise TensorValueError("a window reaches back and ahead, not inwards")
    m, width = F.col(f"i{mode}"), max(BIN, 4 * (before + after))
    own = F.floor(m / width).cast("bigint")
    bins = F.sequence(F.floor((m - after) / width).cast("bigint"), F.floor((m + before) / width).cast("bigint"))
    copies = x.df.select("*", own.alias("_own"), F.explode(bins).alias("_bin"))
    frame = Window.partitionBy(*x.rest(mode), "_bin").orderBy(m).rangeBetween(-before, after)
    wanted = aggregates or {"total": F.sum("v")}
    return copies.select("*", *(a.over(frame).alias(n) for n, a in wanted.items())).where("_bin = _own").drop("_bin", "_own")
