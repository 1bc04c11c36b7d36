"""Contractions in tiles, balanced schedules, chunks and orders, against plain versions."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import tensor
from tensorloom.errors import ShapeMismatchError
from tensorloom.operators import dense_modes, hicoo, matrix, order, positions, products, reshape, tiled
from tensorloom.operators.positions import with_pos
from tensorloom.plans import tucker
from tensorloom.sources.generate import diagonal_tensor
from tensorloom.storage import materialize
from tensorloom.tensor import SparseTensor
from tests.test_tensor import array, dense, frame, random_dense, sparse


@pytest.mark.parametrize("mode", range(3))
@pytest.mark.parametrize("rank, bits", [(3, (1, 2)), (70, (2, 2))])
def test_tiled_contraction(spark, mode, rank, bits):
    a = random_dense(4, (9, 5, 14), 0.3)
    us = [np.random.default_rng(k).normal(size=(n, rank)) for k, n in enumerate(a.shape)]
    want = np.einsum("ijk,jr,kr->ir", np.moveaxis(a, mode, 0), *(us[k] for k in range(3) if k != mode))
    h, fs = hicoo.to_hicoo(sparse(spark, a), *bits), [frame(spark, u) for u in us]
    assert np.allclose(array(tiled.hicoo_mttkrp_tiled(h, fs, mode, rank)), want)
    assert np.allclose(array(tiled.hicoo_mttkrp_balanced(h, fs, mode, rank, 3)), want)


def test_tiles_hold_missing_rows(spark):
    u = spark.createDataFrame([(1, [1.0, 2.0]), (6, [3.0, 4.0])], "row bigint, vals array<double>")
    got = {r["tile"]: r["vals"] for r in tiled.factor_tiles(u, 2, 2).collect()}
    assert got == {0: [0, 0, 1, 2, 0, 0, 0, 0], 1: [0, 0, 0, 0, 3, 4, 0, 0]}


def sent_to_python(plan) -> int:
    """Bytes that tasks of an executed plan have sent to Python."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return sent_to_python(plan.executedPlan())
    if kind.endswith("QueryStage"):
        return sent_to_python(plan.plan())
    here, below = plan.metrics().get("pythonDataSent"), plan.children()
    return (here.get().value() if here.isDefined() else 0) + sum(sent_to_python(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("mode", [0, 1])
def test_tiles_are_not_sent_once_a_block(spark, mode):
    """Blocks of about one entry: what tasks read grows with entries and tiles, not with a tile of 4 KB a block."""
    n, rank = 4000, 16
    rows = spark.range(n).select((F.col("id") * 977 % 2039).alias("i0"), (F.col("id") * 1571 % 2017).alias("i1"), (F.col("id") % 7).alias("i2"), (F.col("id") % 13 + 1).cast("double").alias("v"))
    x = SparseTensor(rows, (2039, 2017, 7))
    h = hicoo.to_hicoo(x, 5, 8)
    us = [np.random.default_rng(k).integers(-5, 6, (d, rank)).astype(float) for k, d in enumerate(x.ndims)]
    got = tiled.hicoo_mttkrp_tiled(h, [frame(spark, u) for u in us], mode, rank, dense=False)
    found, (i, j, k, v) = {r["row"]: r["vals"] for r in got.collect()}, np.array(rows.collect()).T
    at, other = ((i, j), (j, i))[mode]
    want = np.zeros((x.ndims[mode], rank))
    np.add.at(want, at.astype(int), v[:, None] * us[1 - mode][other.astype(int)] * us[2][k.astype(int)])
    assert found == {int(r): list(want[int(r)]) for r in set(at)}
    assert h.df.count() > n // 2 and sent_to_python(got._jdf.queryExecution().executedPlan()) < 1000 * n


def test_a_hot_tile_goes_to_many_tasks(spark, monkeypatch):
    """Most entries are in one tile: they are spread, each after its tile, and a missing tile's blocks add nothing."""
    monkeypatch.setattr(tiled, "A_TASK", 100)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 4).otherwise(F.col("id") % 64).alias("i1"), (F.col("id") % 3).alias("i2"), F.lit(1.0).alias("v"))
    h = hicoo.to_hicoo(SparseTensor.from_dataframe(rows, ["id", "i1", "i2"], "v"), 2, 3)
    us = [matrix.randomize(spark, d, 2, k) for k, d in enumerate(h.ndims)]
    us[1] = us[1].where("row not between 8 and 11")
    sides = tiled._beside(h, h.df.select(*h.blocks, "elems"), tiled._tiles(h, us[1], 1, 2), 1).where("b1 = 0")
    of = sides.groupBy(F.spark_partition_id()).agg(F.sum(F.size("elems")).alias("n"), F.count("_u1").alias("tiles")).where("n > 0").collect()
    assert len(of) > 2 and all(r["tiles"] for r in of) and sum(r["n"] for r in of) > 2700
    plain = products.mttkrp(hicoo.to_coo(h), us, 0, 2)
    assert np.allclose(array(tiled.hicoo_mttkrp_tiled(h, us, 0, 2)), array(plain))
    assert np.allclose(array(tiled.hicoo_mttkrp_tiled(hicoo.HiCOO(h.df, h.ndims, 2, 3), us, 0, 2)), array(plain))


def test_tiled_contraction_of_nothing(spark):
    h = hicoo.to_hicoo(SparseTensor.empty(spark, (4, 4, 4)), 1, 2)
    us = [matrix.randomize(spark, 4, 2, k) for k in range(3)]
    for f in (tiled.hicoo_mttkrp_tiled, tiled.hicoo_mttkrp_balanced):
        assert (array(f(h, us, 0, 2)) == 0).all() and f(h, us, 0, 2, dense=False).count() == 0
    with pytest.raises(ShapeMismatchError):
        tiled.hicoo_mttkrp_tiled(h, us[:2], 0, 2)


def test_many_products_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(tiled, "HELD", 64)
    a = random_dense(8, (16, 16, 16), 0.5)
    us = [np.random.default_rng(k).normal(size=(16, 4)) for k in range(3)]
    h, fs = hicoo.to_hicoo(sparse(spark, a), 2, 3), [frame(spark, u) for u in us]
    want = np.einsum("ijk,jr,kr->ir", a, us[1], us[2])
    assert np.allclose(array(tiled.hicoo_mttkrp_tiled(h, fs, 0, 4)), want) and np.allclose(array(tiled.hicoo_mttkrp_balanced(h, fs, 0, 4, 3)), want)


def test_schedule_splits_a_hot_coordinate(spark):
    """Half the entries share one kernel coordinate: no task gets more than about twice its share of them."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 4096).cast("bigint").alias("i0"), (F.xxhash64("id") % 512 + 512).alias("i1"), (F.col("id") % 1000).alias("i2"), F.lit(1.0).alias("v"))
    h = hicoo.to_hicoo(SparseTensor(rows, (4096, 1024, 1000)), 4, 6)
    parts = 16
    plan = tiled.balanced_schedule(h, 0, parts)
    entries = 40_000 / parts
    for r in plan.collect():
        assert (r["shares"] == 1) == (r["nnz"] <= entries)
    loads = tiled.scheduled_blocks(h, plan, 0, parts).groupBy("part").agg(F.sum("nnz").alias("n")).collect()
    assert len(loads) == parts and max(r["n"] for r in loads) < 2.2 * entries
    whole = tiled.scheduled_blocks(h, plan, 0, parts).where("shares = 1").groupBy("k0").agg(F.count_distinct("part").alias("n"))
    assert whole.where("n > 1").count() == 0
    us = [matrix.randomize(spark, d, 2, k) for k, d in enumerate(h.ndims)]
    assert np.allclose(array(tiled.hicoo_mttkrp_balanced(h, us, 0, 2, parts)), array(products.mttkrp(hicoo.to_coo(h), us, 0, 2)))


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_chunks_over_many_batches(spark, bits):
    a = random_dense(11, (16, 16, 16), 0.4)
    h = hicoo.to_hicoo(sparse(spark, a), 1, 3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted(tuple(r) for r in hicoo.chunk_pointers(h, bits).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, kernel, have = [], None, 0
    for r in hicoo.block_pointers(h).orderBy("bid").collect():
        if r["kid"] != kernel:
            kernel, chunk, have = r["kid"], -1, 1 << bits
        if have >= 1 << bits:
            chunk, have = chunk + 1, 0
            want.append((kernel, chunk, r["bid"]))
        have += r["nnz"]
    assert got == sorted(want)


def test_no_sort_for_the_nth_entry(spark):
    x = sparse(spark, random_dense(3, (30, 40, 50), 0.05))
    doubled = x.with_df(x.df.union(x.df))
    entries = sorted(x.entries() * 2)
    assert [reshape.nth(doubled, n) for n in (0, 1, 777, len(entries) - 1)] == [entries[n] for n in (0, 1, 777, len(entries) - 1)]
    assert reshape.nth(doubled, len(entries)) is None and reshape.nth(SparseTensor.empty(spark, (3, 3)), 0) is None


def slow_search(entries, mode, n):
    """Maximum-cardinality search, an index at a time, by a heap."""
    pins, own, degree = {}, {}, {}
    for e in entries:
        degree[e[mode]] = degree.get(e[mode], 0) + 1
        for k, i in enumerate(e):
            if k != mode:
                pins.setdefault((k, i), []).append(e[mode])
                own.setdefault(e[mode], set()).add((k, i))
    key, seen, out, taken = dict.fromkeys(degree, 0), set(), [], set()
    heap = [(0, -degree[v], v) for v in degree]
    heapq.heapify(heap)
    while heap:
        k, _, v = heapq.heappop(heap)
        if v in taken or -k != key[v]:
            continue
        taken.add(v)
        out.append(v)
        for p in own[v] - seen:
            seen.add(p)
            for w in pins[p]:
                key[w] += 1
                heapq.heappush(heap, (-key[w], -degree[w], w))
    return out + [v for v in range(n) if v not in degree]


def test_mcs_one_by_one(spark):
    draw = np.random.default_rng(3)
    entries = sorted({tuple(int(z) for z in draw.integers(0, (8, 12, 14))) for _ in range(16)})
    x = SparseTensor.from_rows(spark, [(*e, 1.0) for e in entries], (10, 12, 14))
    got = [r["old"] for r in order.mcs_order(x, 0, 0.0).orderBy("new").collect()]
    assert got == slow_search(entries, 0, 10)


def test_mcs_in_batches(spark):
    """Every index of a shuffled band has one place."""
    band = diagonal_tensor(spark, 120)
    shuffled = reshape.relabel(band, order.random_maps(spark, band.ndims, 7))
    shuffled = shuffled.with_df(materialize(shuffled.df, "band"))
    own = order.mcs_order(shuffled, 0)
    places = sorted((r["old"], r["new"]) for r in own.collect())
    assert [p[0] for p in places] == list(range(120)) == sorted(p[1] for p in places)
    assert sorted((r["old"], r["new"]) for r in order.mcs_order(SparseTensor.empty(spark, (3, 2)), 0).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_sort_semisparse(spark):
    a = random_dense(2)
    y = order.sort_semisparse(reshape.to_semisparse(sparse(spark, a), 1))
    keys = [tuple(r[m] for m in y.rest) for r in y.df.collect()]
    assert keys == sorted(keys) and (dense(reshape.from_semisparse(y)) == a).all()


def blocks(y):
    """A dense array of all modes."""
    out = np.zeros(y.ndims)
    for r in y.df.collect():
        at = np.array(r["block"]).reshape(y.sizes)
        fixed = tuple(r[f"i{k}"] if k not in y.dense else slice(None) for k in range(len(y.ndims)))
        left = [k for k in range(len(y.ndims)) if k in y.dense]
        out[fixed] += np.transpose(at, [y.dense.index(k) for k in left])
    return out


@pytest.mark.parametrize("dense_", [(2,), (2, 0), (0, 1), (0, 2, 1)])
def test_dense_modes(spark, dense_):
    a = random_dense(21, (5, 4, 6), 0.3)
    y = dense_modes.to_blocks(sparse(spark, a), dense_)
    assert (blocks(y) == a).all() and (dense(dense_modes.from_blocks(y)) == a).all()
    assert dense_modes.norm_squared_df(y).first()[0] == (a**2).sum()
    assert (blocks(dense_modes.add(y, dense_modes.scale(y, -3))) == -2 * a).all()
    z = dense_modes.to_blocks(sparse(spark, random_dense(22, (5, 4, 6), 0.1)), dense_)
    assert (blocks(dense_modes.add(y, z)) == a + random_dense(22, (5, 4, 6), 0.1)).all()


@pytest.mark.parametrize("ranks", [(2, 3, 2), (3, 4, 9)])
def test_ttm_chain_in_blocks(spark, ranks):
    """All modes in turn, sparse and dense ones, small blocks and large."""
    a = random_dense(23, (5, 4, 6), 0.3)
    us = [np.random.default_rng(k).normal(size=(n, r)) for k, (n, r) in enumerate(zip(a.shape, ranks))]
    y, want = dense_modes.to_blocks(sparse(spark, a), [2]), a
    for m in (1, 2, 0):
        y = dense_modes.ttm(y, frame(spark, us[m]), m, a.shape[m], ranks[m])
        want = np.moveaxis(np.tensordot(want, us[m], axes=(m, 0)), -1, m)
        assert np.allclose(blocks(y), want)
    assert y.dense == (2, 1, 0) and y.sparse == []


def test_blocks_of_nothing(spark):
    y = dense_modes.to_blocks(SparseTensor.empty(spark, (3, 4, 2)), [1])
    for m in range(3):
        y = dense_modes.ttm(y, matrix.randomize(spark, y.ndims[m], 2, m), m, y.ndims[m], 2)
        assert y.df.count() == 0
    for wrong in ((), (0, 0), (3,)):
        with pytest.raises(ShapeMismatchError):
            dense_modes.to_blocks(SparseTensor.empty(spark, (3, 4, 2)), wrong)
    with pytest.raises(ShapeMismatchError):
        dense_modes.ttm(y, matrix.randomize(spark, 9, 2), 0, 9, 2)


def test_tucker_against_numpy(spark):
    """Four modes: the tree's halves; the same start and as many iterations give the same factors but for signs."""
    a, ranks = random_dense(31, (5, 4, 6, 3), 0.3), (2, 3, 2, 2)
    fs = [array(matrix.randomize(spark, d, r, k)) for k, (d, r) in enumerate(zip(a.shape, ranks))]
    times = lambda y, m: np.moveaxis(np.tensordot(y, fs[m], axes=(m, 0)), -1, m)
    for _ in range(2):
        for m in range(4):
            y = a
            for k in range(4):
                y = times(y, k) if k != m else y
            fs[m] = np.linalg.svd(np.moveaxis(y, m, 0).reshape(a.shape[m], -1), full_matrices=False)[0][:, : ranks[m]]
    want = times(y, 3)
    core, got = tucker.tucker(sparse(spark, a), ranks, niters=2)
    assert core.ndims == ranks and np.linalg.norm(dense(core)) == pytest.approx(np.linalg.norm(want), rel=1e-9)
    for g, f, d in zip(got, fs, a.shape):
        full = np.zeros((d, f.shape[1]))
        for r in g.collect():
            full[r["row"]] = r["vals"]
        assert np.allclose(full @ full.T, f @ f.T, atol=1e-8) and np.allclose(full.T @ full, np.eye(f.shape[1]), atol=1e-8)
    with pytest.raises(ShapeMismatchError):
        tucker.tucker(sparse(spark, a), (2, 3, 2, 13))


def test_tasks_of_blocks_follow_the_known_number_of_entries(spark, monkeypatch):
    """Rows are dealt out before they are summed, blocks and kernels to as many tasks as there are entries for; kernels aren't cut."""
    rows = spark.createDataFrame([(i * 7 % 50, i * 11 % 60, i % 40, 1.0) for i in range(900)] * 2, "a bigint, b bigint, c bigint, v double")
    plain = SparseTensor.from_dataframe(rows, ["a", "b", "c"], "v")
    want = {f: sorted(map(tuple, f(hicoo.to_hicoo(plain, 2, 4)).collect())) for f in (hicoo.kernel_pointers, hicoo.block_pointers, hicoo.chunk_pointers, hicoo.schedule, hicoo.status)}
    blocks = sorted(map(tuple, hicoo.to_hicoo(plain, 2, 4).df.collect()))
    monkeypatch.setattr(tensor, "A_TASK", 100)
    ranges = []
    monkeypatch.setattr(positions, "materialize", lambda df, tag: (ranges.append(df.rdd.getNumPartitions()), materialize(df, tag))[1])
    x = SparseTensor.from_dataframe(rows, ["a", "b", "c"], "v")
    assert x.most == 1800 and x.dealt(["i0"]).rdd.getNumPartitions() == 18
    h = hicoo.to_hicoo(x, 2, 4)
    plan = h.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # rows are shuffled once, neither sums nor blocks are
    assert sorted(map(tuple, h.df.collect())) == blocks
    for f, rows_of in want.items():
        assert sorted(map(tuple, f(h).collect())) == rows_of
    assert ranges and min(ranges) >= 18


def test_runs_are_numbered_over_partitions(spark):
    df = spark.createDataFrame([(i // 7 % 5, i // 3, i) for i in range(200)], "a bigint, b bigint, n bigint")
    got = with_pos(df, ["a", "b", "n"], {"before": "n"}, {"run": ["a", "b"]}).orderBy("pos").collect()
    want, total = sorted((i // 7 % 5, i // 3, i) for i in range(200)), 0
    groups = sorted({w[:2] for w in want})
    assert [r["run"] for r in got] == [groups.index(w[:2]) for w in want]
    for r, w in zip(got, want):
        assert (r["a"], r["b"], r["n"], r["before"]) == (*w, total)
        total += w[2]
