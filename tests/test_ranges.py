"""Joins by range and windows along a mode, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.operators import ranges
from tensorloom.tensor import SparseTensor


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def boxes(spark):
    r = random.Random(1)
    span = lambda low, n: (low, low + n)
    rows = [(k, *span(r.randrange(-40, 200), r.choice([-1, 0, 1, 3, 17, 90])), *span(r.randrange(100), r.choice([0, 5, 40]))) for k in range(100)]
    rows += [(100, None, 5, 0, 99), (101, 0, None, 0, 99), *rows[:3]]
    return rows, spark.createDataFrame(rows, "bid int, al int, ah int, bl int, bh int")


@pytest.fixture
def points(spark):
    r = random.Random(2)
    rows = [(k, r.choice([None, *range(-30, 200)]), r.randrange(100)) for k in range(400)] + [(400, 7, None), (5, 9, 9), (5, 9, 9)]
    return rows, spark.createDataFrame(rows, "pid int, a int, b int")


def held(x, low, high):
    return None not in (x, low, high) and low <= x <= high


@pytest.mark.parametrize("fine", [0, 1, 3])
def test_points_in_boxes(points, boxes, fine):
    found = ranges.within(points[1], boxes[1], [("a", "al", "ah"), ("b", "bl", "bh")], fine=fine)
    want = sorted((p[0], b[0]) for p in points[0] for b in boxes[0] if held(p[1], b[1], b[2]) and held(p[2], b[3], b[4]))
    assert want and sorted((r.pid, r.bid) for r in found.collect()) == want
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)


def test_many_levels_are_rounded_up(spark, monkeypatch, points, boxes):
    monkeypatch.setattr(ranges, "MOST_LEVELS", 4)
    found = ranges.within(points[1], boxes[1], [("a", "al", "ah"), ("b", "bl", "bh")])
    assert found.count() == sum(held(p[1], b[1], b[2]) and held(p[2], b[3], b[4]) for p in points[0] for b in boxes[0])


def test_keys_and_more_sides_than_cells(spark):
    r = random.Random(3)
    ps = [tuple(r.randrange(8) for _ in range(5)) for _ in range(200)]
    bs = [tuple(x for _ in range(4) for x in sorted((r.randrange(8), r.randrange(8)))) + (r.randrange(8),) for _ in range(40)]
    p = spark.createDataFrame(ps, "a int, b int, c int, d int, k int")
    b = spark.createDataFrame(bs, "al int, ah int, bl int, bh int, cl int, ch int, dl int, dh int, l int")
    found = ranges.within(p, b, [(m, f"{m}l", f"{m}h") for m in "abcd"], [("k", "l")])
    assert found.count() == sum(x[4] == y[8] and all(y[2 * m] <= x[m] <= y[2 * m + 1] for m in range(4)) for x in ps for y in bs)


def test_no_box_and_clashing_names(spark, points, boxes):
    none = ranges.within(points[1], boxes[1].where("false"), [("a", "al", "ah")])
    assert none.count() == 0 and none.columns == [*points[1].columns, *boxes[1].columns]
    assert ranges.within(points[1].where("false"), boxes[1], [("a", "al", "ah")]).count() == 0
    with pytest.raises(ShapeMismatchError):
        ranges.within(points[1], points[1], [("a", "a", "b")])
    with pytest.raises(TensorValueError):
        ranges.within(points[1], boxes[1], [])


def test_overlaps(boxes):
    rows, df = boxes
    other = df.select(F.col("bid").alias("cid"), F.col("bl").alias("cl"), F.col("bh").alias("ch"))
    found = ranges.overlaps(df.select("bid", "al", "ah"), other, ("al", "ah"), ("cl", "ch"))
    want = sorted((x[0], y[0]) for x in rows for y in rows if None not in x and x[1] <= x[2] and y[3] <= y[4] and x[1] <= y[4] and y[3] <= x[2])
    assert sorted((r.bid, r.cid) for r in found.collect()) == want
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    r = random.Random(4)
    left = [(k, r.choice([0, 0, 0, 1, None]), r.choice([None, *range(60)])) for k in range(500)] + [(3, 0, 9)] * 2
    right = [(r.choice([0, 0, 1, 2, None]), r.choice([None, *range(60)]), r.choice([None, r.random()])) for _ in range(80)]
    found = ranges.as_of(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, w double"), ["k"], "t", ["w"], strict)

    def last(k, t):
        before = [(at, -1 if w is None else w) for key, at, w in right if None not in (k, t, key, at) and key == k and (at < t if strict else at <= t)]
        return (max(before)[0], None if max(before)[1] == -1 else max(before)[1]) if before else None

    got = sorted(((x.id, tuple(x["last"]) if x["last"] else None) for x in found.collect()), key=str)
    assert got == sorted(((i, last(k, t)) for i, k, t in left), key=str)


def test_as_of_across_partitions_without_keys(spark):
    """One right row far before all left ones; no partition but the first holds it."""
    left = spark.range(10, 2000).select(F.col("id").alias("t"))
    right = spark.createDataFrame([(0, "a"), (5000, "b")], "t bigint, name string")
    found = ranges.as_of(left, right, [], "t", ["name"])
    assert found.groupBy("last.name").count().collect() == [("a", 1990)]
    assert ranges.as_of(left, right.where("false"), [], "t", ["name"]).where("last IS NULL").count() == 1990
    assert ranges.as_of(left.where("false"), right, [], "t", ["name"]).count() == 0
    with pytest.raises(ShapeMismatchError):
        ranges.as_of(left, right, [], "t", ["name"], into="t")


def test_previous(spark):
    x = SparseTensor.from_rows(spark, [(0, 3, 1), (0, 7, 2), (1, 2, 3), (0, 9, 4)], (2, 10))
    got = {(r.i0, r.i1): tuple(r["last"]) if r["last"] else None for r in ranges.previous(x, 1).collect()}
    assert got == {(0, 3): None, (0, 7): (3, 1.0), (0, 9): (7, 2.0), (1, 2): None}


@pytest.mark.parametrize("before, after", [(0, 0), (3, 0), (0, 2), (25, 40)])
def test_moving_sums_over_bins(spark, monkeypatch, before, after):
    monkeypatch.setattr(ranges, "BIN", 8)
    r = random.Random(5)
    cells = {(r.randrange(3), r.randrange(300)): float(r.randrange(9)) for _ in range(400)}
    x = SparseTensor.from_rows(spark, [(*c, v) for c, v in cells.items()], (3, 300))
    found = ranges.moving(x, 1, before, after, {"total": F.sum("v"), "n": F.count("*")})
    for row in found.collect():
        near = [v for (a, b), v in cells.items() if a == row.i0 and row.i1 - before <= b <= row.i1 + after]
        assert (row.total, row.n) == (sum(near), len(near))
    assert found.count() == len(cells)


def test_a_long_fiber_is_cut(spark):
    x = SparseTensor(spark.range(100_000).select(F.lit(0).cast("bigint").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (1, 100_000))
    found = ranges.moving(x, 1, 5)
    assert "_bin" in plan(found).split("Window")[1]
    assert found.groupBy("total").count().orderBy("total").collect()[-1] == (6.0, 99_995)
    with pytest.raises(TensorValueError):
        ranges.moving(x, 1, -1)
