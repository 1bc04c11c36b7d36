"""What queries and operators do as the tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from tensorloom import queries, tensor
from tensorloom.operators import dense_modes, hicoo, ranges
from tensorloom.plans import cpd
from tensorloom.tensor import SparseTensor


def test_morton_order_is_settled_beyond_twenty_bits(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(3), p + high, 1, 1.0) for p in range(60) for high in (0, 1 << 20)]
    lines = spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted(queries.Q["sort_morton"](spark, str(tmp_path)).collect(), key=lambda x: x.pos)
    bits = lambda x: sum((x[k] >> b & 1) << 3 * b + 2 - k for b in range(20) for k in range(3))
    cells = [(x.i0, x.i1, x.i2) for x in found]
    assert len({bits(x) for x in cells}) < len(cells)
    assert [x.pos for x in found] == list(range(len(cells))) and cells == sorted(cells, key=lambda x: (bits(x), x))


def test_points_go_to_few_levels_and_no_exploded_side_is_broadcast(spark):
    boxes = spark.range(700).select(F.col("id").alias("lo"), (F.col("id") * 2).alias("hi"))  # ten levels
    found = ranges.within(spark.range(500).select(F.col("id").alias("at")), boxes, [("at", "lo", "hi")])
    text = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" in text.split("== Physical Plan ==")[1] and "BroadcastHashJoin" not in text
    cells = text.split("== Optimized Logical Plan ==")[1].split("explode(")[1].split("\n")[0]
    assert cells.count("_m0") <= 3
    assert found.count() == sum(x <= at <= 2 * x for x in range(700) for at in range(500))


def test_levels_that_would_widen_cells_too_much_stay_apart():
    tiny = {(0,): 10**9, (40,): 1}
    assert ranges._coarser(tiny)[0] == [(0,), (40,)]
    assert ranges._coarser({(x,): 1 << x for x in range(10)})[0] == [(1,), (5,), (9,)]
    assert len(ranges._coarser({(x, y): 1 for x in range(60) for y in range(60)})[0]) <= ranges.MOST_LEVELS


@pytest.mark.parametrize("build", [lambda x: hicoo.to_hicoo(x, 2, 4).df, lambda x: dense_modes.to_blocks(x, [2]).df])
def test_blocks_come_from_as_many_tasks_as_there_are_entries_for(spark, monkeypatch, build):
    monkeypatch.setattr(tensor, "A_TASK", 100)
    rows = spark.range(5000).select((F.col("id") % 71).alias("a"), (F.col("id") % 1009).alias("b"), (F.col("id") % 7).alias("c"), F.lit(1.0).alias("w"))
    x = SparseTensor.from_dataframe(rows, ["a", "b", "c"], "w")
    found = build(x)
    assert x.most == 5000 and found.rdd.getNumPartitions() == 50
    assert sorted(map(str, found.collect())) == sorted(map(str, build(SparseTensor(x.df, x.ndims)).collect()))


@pytest.mark.parametrize("blocked", [False, True])
def test_large_factors_of_a_decomposition_are_not_broadcast(spark, monkeypatch, blocked):
    r = random.Random(2)
    cells = {(r.randrange(4), r.randrange(300), r.randrange(3)): float(r.randrange(1, 9)) for _ in range(600)}
    x = SparseTensor.from_rows(spark, [(*c, v) for c, v in cells.items()], (4, 300, 3))
    x = hicoo.to_hicoo(x, 2, 4) if blocked else x
    want = cpd.cpd_als(x, 2, 2)
    monkeypatch.setattr(cpd, "STEP_BYTES", 1000)
    limits, step = [], cpd.mttkrp

    def seen(entries, *args, **more):
        out = step(entries, *args, **more)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        limits.append((args[1], "InMemoryRelation" in plan, plan.count("strategy=broadcast")))
        return out

    monkeypatch.setattr(cpd, "mttkrp", seen)
    found = cpd.cpd_als(x, 2, 2)
    assert found.fit == pytest.approx(want.fit) and found.lam == pytest.approx(want.lam)
    assert all(kept for _, kept, _ in limits) and {(m, n) for m, _, n in limits} == {(0, 2), (1, 2), (2, 2)}
