"""Operators against dense numpy, golden cases and algebraic identities."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.errors import ShapeMismatchError, TensorValueError, TensorZeroDivisionError
from tensorloom.functions import keys, vectors
from tensorloom.operators import elementwise, hicoo, matrix, order, products, reduce, reshape
from tensorloom.plans.cpd import cpd_als, fit_of, inner_df, model_norm_squared
from tensorloom.plans.tucker import tucker
from tensorloom.sources import generate, text
from tensorloom.tensor import SemiSparseTensor, SparseTensor

DIMS = (5, 4, 6)


def random_dense(seed, dims=DIMS, share=0.4):
    draw = np.random.default_rng(seed)
    return draw.integers(-4, 5, dims) * (draw.random(dims) < share).astype(float)


def sparse(spark, a):
    return SparseTensor.from_rows(spark, [(*map(int, i), a[tuple(i)]) for i in np.argwhere(a)], a.shape)


def dense(x):
    out = np.zeros(x.ndims)
    for *i, v in x.df.collect():
        out[tuple(i)] += v
    return out


def frame(spark, m):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "row bigint, vals array<double>")


def array(df):
    return np.array([r["vals"] for r in df.orderBy("row").collect()])


def fibers(y):
    out = np.zeros(y.ndims)
    rest = [int(m[1:]) for m in y.rest]
    for r in y.df.collect():
        at = [slice(None)] * len(y.ndims)
        for k in rest:
            at[k] = r[f"i{k}"]
        out[tuple(at)] += r["fiber"]
    return out


@pytest.fixture(scope="module")
def a():
    return random_dense(1)


@pytest.fixture(scope="module")
def b():
    return random_dense(2)


def test_elementwise(spark, a, b):
    x, y = sparse(spark, a), sparse(spark, b)
    assert (dense(x + y) == a + b).all() and (dense(x - y) == a - b).all() and (dense(x * y) == a * b).all()
    assert (dense(2 * x) == 2 * a).all() and (dense(x / 2) == a / 2).all() and (x - x).nnz == 0 and (x * 0).nnz == 0
    both = (a != 0) & (b != 0)
    quotient = np.divide(a, b, out=np.zeros_like(a), where=both)
    assert np.allclose(dense(x / y), quotient) and np.allclose(dense(y.ldivide(x)), quotient) and (dense(x.ldivide(2)) == a / 2).all()
    assert (dense(elementwise.dot_mul_eq(x, x)) == a * a).all() and (dense(elementwise.mask(x, y)) == a * (b != 0)).all() and (dense(elementwise.unmask(x, y)) == a * (b == 0)).all()
    assert (x + y).df.where("v = 0").count() == 0
    with pytest.raises(ShapeMismatchError):
        elementwise.dot_mul_eq(x, y)
    with pytest.raises(ShapeMismatchError):
        x + sparse(spark, random_dense(3, (5, 4)))
    with pytest.raises(TensorZeroDivisionError):
        x / 0


def test_division_by_explicit_zero(spark):
    x, y = SparseTensor.from_rows(spark, [(0, 1), (1, -1), (2, 0)], (3,)), SparseTensor.from_rows(spark, [(0, 0), (1, 0), (2, 0)], (3,))
    v = [r[1] for r in (x / y).entries()]
    assert v[0] == np.inf and v[1] == -np.inf and np.isnan(v[2])


def test_reductions(spark, a):
    x = sparse(spark, a)
    nnz = np.count_nonzero(a)
    assert reduce.norm(x) == pytest.approx(np.linalg.norm(a)) and reduce.density(x) == pytest.approx(nnz / a.size)
    assert [tuple(r) for r in reduce.index_bounds(x).orderBy("mode").collect()] == [(k, int(i.min()), int(i.max()) + 1) for k, i in enumerate(np.nonzero(a))]
    assert [r["nnz"] for r in reduce.slice_sizes(x, 2).orderBy("idx").collect()] == list(np.count_nonzero(a, axis=(0, 1)))
    row = reduce.status_df(x).first()
    assert row["nnz"] == nnz and row["bytes"] == nnz * 16 and row["slice_len"] == pytest.approx([nnz / d for d in DIMS])
    empty = SparseTensor.empty(spark, DIMS)
    assert reduce.norm(empty) == 0 and reduce.density(empty) == 0 and {tuple(r)[1:] for r in reduce.index_bounds(empty).collect()} == {(0, 0)}
    assert reduce.bytes_string(10) == "10 Bytes" and reduce.bytes_string(1536) == "1.50 KiB"
    assert reduce.top_k(x, 3).nnz == 3 and reduce.marginals(x).where("i0 is null and i1 is null and i2 is null").first()["v"] == a.sum()


@pytest.mark.parametrize("mode", range(3))
def test_contractions(spark, a, mode):
    x, draw = sparse(spark, a), np.random.default_rng(5)
    u = draw.normal(size=(DIMS[mode], 3))
    want = np.moveaxis(np.tensordot(a, u, (mode, 0)), -1, mode)
    y = products.ttm(x, frame(spark, u), mode, *u.shape)
    assert np.allclose(fibers(y), want)
    w = spark.createDataFrame([(i, float(v)) for i, v in enumerate(u[:, 0])], "pos bigint, v double")
    assert np.allclose(fibers(products.ttv(x, w, mode, DIMS[mode])), want.take([0], mode))
    t = draw.normal(size=(3, 2))
    assert np.allclose(fibers(products.sttm(y, frame(spark, t), mode, 3, 2)), np.moveaxis(np.tensordot(want, t, (mode, 0)), -1, mode))
    with pytest.raises(ShapeMismatchError):
        products.ttm(x, frame(spark, u), mode, 99, 3)
    with pytest.raises(ShapeMismatchError):
        products.sttm(y, frame(spark, t), (mode + 1) % 3, 3, 2)


@pytest.mark.parametrize("wide", [64, 1])
@pytest.mark.parametrize("mode", range(3))
def test_mttkrp(spark, a, mode, wide, monkeypatch):
    monkeypatch.setattr(products, "WIDE", wide)
    x, draw = sparse(spark, a), np.random.default_rng(6)
    us = [draw.normal(size=(d, 3)) for d in DIMS]
    letters = "ijk"
    rest = [k for k in range(3) if k != mode]
    want = np.einsum(f"ijk,{','.join(letters[k] + 'r' for k in rest)}->{letters[mode]}r", a, *(us[k] for k in rest))
    fs = [frame(spark, u) for u in us]
    assert np.allclose(array(products.mttkrp(x, fs, mode, 3)), want)
    assert np.allclose(array(hicoo.hicoo_mttkrp(hicoo.to_hicoo(x, 1, 2), fs, mode, 3)), want)


def test_golden_ttm(spark):
    """A fixed case: X[i,j,k] = 4i + 2j + k + 1 and U = [[1, 3], [2, 4]], along mode 0."""
    x = sparse(spark, np.arange(1.0, 9).reshape(2, 2, 2))
    y = reshape.from_semisparse(products.ttm(x, frame(spark, [[1, 3], [2, 4]]), 0, 2, 2), 1e-6)
    assert [r[-1] for r in y.entries()] == [11, 14, 17, 20, 23, 30, 37, 44]


def test_products_of_tensors(spark):
    a, b = random_dense(7, (2, 3, 2), 0.7), random_dense(8, (3, 2, 2), 0.7)
    x, y = sparse(spark, a), sparse(spark, b)
    assert (dense(products.kronecker(x, y)) == np.kron(a, b)).all()
    want = np.stack([np.kron(a[..., k], b[..., k]) for k in range(2)], -1)
    assert (dense(products.khatri_rao(x, y)) == want).all()
    with pytest.raises(ShapeMismatchError):
        products.khatri_rao(x, sparse(spark, random_dense(9, (3, 2, 3))))
    with pytest.raises(TensorValueError):
        products.kronecker(x, y, most=5)


def test_formats(spark, a):
    x = sparse(spark, a)
    for mode in range(3):
        y = reshape.to_semisparse(x, mode)
        assert (fibers(y) == a).all() and (dense(reshape.from_semisparse(y)) == a).all()
        assert (fibers(reshape.set_mode(y, (mode + 1) % 3)) == a).all() and reshape.set_mode(y, (mode + 1) % 3).mode == (mode + 1) % 3
        assert (fibers(reshape.merge_fibers(SemiSparseTensor(y.df.unionByName(y.df), y.ndims, mode))) == 2 * a).all()
        assert reduce.semi_norm_df(y).first()[0] == pytest.approx(np.linalg.norm(a))
        rest = [(mode + 1) % 3, (mode + 2) % 3]
        unfolded = np.transpose(a, [mode, *rest]).reshape(DIMS[mode], -1)
        for t in (0, 1):
            got = np.zeros(unfolded.shape if t else unfolded.T.shape)
            for r, c, v in reshape.matricize(x, mode, t).collect():
                got[r, c] = v
            assert (got == (unfolded if t else unfolded.T)).all()
    m = random_dense(10, (4, 3))
    assert (array(reshape.to_dense(sparse(spark, m))) == m).all()
    with pytest.raises(ShapeMismatchError):
        reshape.to_dense(x)
    with pytest.raises(TensorValueError):
        reshape.matricize(x, 0, 2)
    with pytest.raises(ShapeMismatchError):
        SemiSparseTensor(x.df, (3,), 0)


def test_semisparse_keeps_what_it_should(spark):
    df = spark.createDataFrame([(0, [1e-9, float("nan"), float("inf"), 0.0, -2.0])], "i0 bigint, fiber array<double>")
    assert [r[1] for r in reshape.from_semisparse(SemiSparseTensor(df, (1, 5), 1), 1e-6).entries()] == [1, 2, 4]
    y = reshape.to_semisparse(sparse(spark, np.array([[1.0, 0], [0, 2]])), 1)
    new = spark.createDataFrame([(0, 0, 5.0, 1), (0, 0, 6.0, 2), (1, 0, 7.0, 1)], "i0 bigint, i1 bigint, v double, seq bigint")
    assert (fibers(reshape.append(y, new)) == [[6, 0], [7, 2]]).all()


def test_fiber_index_and_csr(spark, a):
    x = sparse(spark, a)
    found = reshape.fiber_index(x, 2).orderBy("pos").collect()
    rows = [(i, j) for i, j in itertools.product(range(5), range(4)) if a[i, j].any()]
    counts = [np.count_nonzero(a[i, j]) for i, j in rows]
    assert [(r["i0"], r["i1"], r["nnz"], r["fiberidx"]) for r in found] == [(*ij, n, sum(counts[:k])) for k, (ij, n) in enumerate(zip(rows, counts))]
    csr = reshape.to_csr(reshape.to_semisparse(x, 2)).orderBy("row").collect()
    assert [r["vals"] for r in csr] == [list(a[i, j]) for i, j in rows] and [r["rowptr"] for r in csr] == [6 * k for k in range(len(rows))]


def test_slices_and_tools(spark, a):
    x = sparse(spark, a)
    want = np.zeros_like(a)
    want[1:3, 0:2, 2:6] = a[1:3, 0:2, 2:6]
    assert (dense(reshape.subtensor(x, (1, 0, 2), (3, 2, 6))) == want).all()
    assert (dense(reshape.crop(x, ["2:4", "-", ":"])) == np.where(np.isin(np.arange(5), [1, 2])[:, None], a.sum(1), 0)).all()
    assert (dense(reshape.crop(x, ["3", ":2", "2:"]))[2, 0, 1:] == a[2, 0, 1:]).all()
    with pytest.raises(TensorValueError):
        reshape.crop(x, ["x", ":", ":"])
    small = np.zeros((9, 7, 3))
    small[2, 3, 1], small[7, 3, 2] = 5, 6
    assert reshape.reindex(sparse(spark, small)).entries() == [(0, 0, 5.0), (1, 1, 6.0)]
    assert [reshape.nth(x, n) for n in (0, 7, 20, 10_000)] == [x.entries()[0], x.entries()[7], x.entries()[20], None]
    twice = x.with_df(x.df.unionByName(x.df)).coalesce_duplicates()
    assert (dense(twice) == 2 * a).all()
    with pytest.raises(TensorValueError):
        SparseTensor(x.df, (2, 2, 2)).check_bounds()


def test_orders(spark, a):
    x = sparse(spark, a)
    rows = x.entries()
    at = lambda df: [tuple(r)[:-1] for r in df.orderBy("pos").collect()]
    assert at(order.with_pos(x.df, ["i1", "i2", "i0"])) == sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    z = lambda r: sum((r[k] >> b & 1) << (3 * b + 2 - k) for b in range(8) for k in range(3))
    assert at(order.with_pos(x.df, order.morton_keys(x))) == sorted(rows, key=z)
    assert at(order.with_pos(x.df, order.mixed_keys(x, 1))) == sorted(rows, key=lambda r: ([i >> 1 for i in r[:3]], z(r)))
    s = order.sort_at_mode(x, 0)
    assert s.sortorder == (1, 2, 0) and order.sort_at_mode(s, 0) is s and order.sort_lexi(s).sortorder == (0, 1, 2)
    assert [tuple(r) for r in order.sort_lexi(s).df.collect()] == rows
    assert sorted(map(tuple, order.shuffle_entries(x, 3).df.collect())) == rows
    assert keys.best_mode_order(DIMS, 2) == [2, 1, 0] and keys.worst_mode_order(DIMS, 2) == [0, 1, 2]
    wide = keys.morton([F.lit(2**40 + 1), F.lit(3), F.lit(0)], 41)
    assert len(wide) == 2 and order.distribute(x, 3).df.rdd.getNumPartitions() == 3
    assert spark.range(1).select(keys.compare([F.lit(1), F.lit(2)], [F.lit(1), F.lit(3)])).first()[0] == -1


@pytest.mark.parametrize("how", ["lexi", "bfs", "random"])
def test_renumbering_permutes_and_inverts(spark, a, how):
    x = sparse(spark, a)
    maps = order.renumber(x, how, iterations=2, seed=4)
    for k, d in enumerate(DIMS):
        own = maps.where(F.col("mode") == k).collect()
        assert sorted(r["old"] for r in own) == sorted(r["new"] for r in own) == list(range(d))
    y = reshape.relabel(x, maps)
    assert sorted(r[-1] for r in y.entries()) == sorted(r[-1] for r in x.entries())
    assert (dense(reshape.relabel(y, reshape.invert_map(maps))) == a).all()


def test_bfs_order_is_by_components_and_levels(spark):
    """A long chain and a star, indices apart, against a plain search."""
    edges = [(k + j, k) for k in range(0, 40) for j in (0, 1)] + [(50 + k, 100) for k in range(5)] + [(50, 101), (50, 102), (50, 103)]
    x = SparseTensor(spark.createDataFrame([(i, e, 1.0) for i, e in edges], "i0 bigint, i1 bigint, v double"), (60, 110))
    n = {i: sum(a == i for a, _ in edges) for i, _ in edges}
    left, want = {*n}, []
    while left:
        front, seen = [min(left, key=lambda i: (-n[i], i))], []
        while front:
            seen += sorted(front, key=lambda i: (-n[i], i))
            near = {e for i, e in edges if i in front}
            front = [i for i in {i for i, e in edges if e in near} if i not in seen]
        want += seen
        left -= {*seen}
    want += [i for i in range(60) if i not in n]
    found = {r["new"]: r["old"] for r in order.bfs_order(x, 0).collect()}
    assert [found[k] for k in range(60)] == want


def test_lexi_order_refines(spark, a):
    found = {r["old"]: r["new"] for r in order.lexi_order(sparse(spark, a), 0).collect()}
    hit = lambda i: tuple(int(not v) for v in (a[i] != 0).ravel())
    assert sorted(range(5), key=lambda i: (hit(i), i)) == sorted(range(5), key=found.get)


@pytest.mark.parametrize("gather", [2, 3, 1024])
def test_lexi_order_of_long_slices(spark, gather):
    """Slices equal, prefixes of others, unused and of all lengths, gathered in several rounds."""
    b = (np.random.default_rng(6).random((12, 5, 6)) < np.linspace(0, 1, 12).reshape(12, 1, 1)).astype(float)
    b[4], b[7], b[9] = b[8], b[10], 0
    b[10].ravel()[20:] = 0
    hit = lambda i: (*np.flatnonzero(b[i].ravel()), 2**63 - 1)
    found = {r["new"]: r["old"] for r in order.lexi_order(sparse(spark, b), 0, gather).collect()}
    assert [found[k] for k in range(12)] == sorted(range(12), key=lambda i: (hit(i), i))


def test_lexi_order_of_nothing(spark):
    x = SparseTensor.from_rows(spark, [], (3, 2, 2))
    assert sorted((r["old"], r["new"]) for r in order.lexi_order(x, 0).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_hicoo(spark, a):
    x = sparse(spark, a)
    h = hicoo.to_hicoo(x, 1, 2)
    assert (dense(hicoo.to_coo(h)) == a).all() and hicoo.norm_squared_df(h).first()[0] == (a**2).sum()
    kernels = hicoo.kernel_pointers(h).orderBy("kid").collect()
    blocks = hicoo.block_pointers(h).orderBy("bid").collect()
    assert [r["kid"] for r in kernels] == list(range(len(kernels))) and [r["bid"] for r in blocks] == list(range(len(blocks)))
    assert kernels[-1]["kptr"] + kernels[-1]["nnz"] == np.count_nonzero(a) == blocks[-1]["bptr"] + blocks[-1]["nnz"]
    kids = {(r["k0"], r["k1"], r["k2"]): r["kid"] for r in kernels}
    want = [(m, c, place, kid) for m in range(3) for c in {k[m] for k in kids} for place, kid in enumerate(sorted(v for k, v in kids.items() if k[m] == c))]
    assert sorted(tuple(r) for r in hicoo.schedule(h).collect()) == sorted(want)
    z = lambda r: sum((r[f"b{m}"] >> b & 1) << 3 * b + 2 - m for b in range(9) for m in range(3))
    assert [r["bid"] for r in sorted(blocks, key=lambda r: (r["kid"], z(r)))] == list(range(len(blocks)))
    assert [r["bptr"] for r in blocks] == [sum(q["nnz"] for q in blocks[:k]) for k in range(len(blocks))]
    s = hicoo.status(h).first()
    assert s["nc"] == hicoo.chunk_pointers(h).count() and s["kdim0"] == -(-DIMS[0] // 4)
    us = [matrix.randomize(spark, d, 3, k) for k, d in enumerate(DIMS)]
    one, two = ({r["row"]: r["vals"] for r in f(h, us, 1, 3).collect()} for f in (hicoo.hicoo_mttkrp, hicoo.hicoo_mttkrp_scheduled))
    assert all(np.allclose(one[k], two[k]) for k in one) and {*one} == {*two}
    want, last, n = [], None, 0
    for r in blocks:
        if r["kid"] != last or n >= 2:
            want.append((r["kid"], r["bid"]))
            n = 0
        last, n = r["kid"], n + r["nnz"]
    assert sorted((r["kid"], r["first_block"]) for r in hicoo.chunk_pointers(h, 1).collect()) == want
    assert hicoo.status(h).first()["nb"] == len(blocks) and hicoo.block_end(4, 2, 6) == 6
    lines = text.hicoo_lines(h)
    assert lines.where("part = 'elems'").count() == np.count_nonzero(a)
    with pytest.raises(TensorValueError):
        hicoo.to_hicoo(x, 4, 2)


def test_matrices(spark):
    draw = np.random.default_rng(3)
    m, n = draw.normal(size=(7, 3)), draw.normal(size=(7, 3))
    f, g = frame(spark, m), frame(spark, n)
    assert np.allclose(array(matrix.dot_mul(f, g)), m * n) and np.allclose(matrix.gram(f, 3), m.T @ m)
    scaled, lam = matrix.norm2(f, 3)
    assert np.allclose(lam, np.linalg.norm(m, axis=0)) and np.allclose(array(scaled), m / lam)
    scaled, lam = matrix.max_norm(f, 3)
    assert np.allclose(lam, np.maximum(1, m.max(0))) and np.allclose(array(scaled), m / lam)
    assert (array(matrix.identity(spark, 4)) == np.eye(4)).all() and (array(matrix.constant(spark, 2, 3, 5)) == 5).all()
    r = array(matrix.randomize(spark, 500, 2, 1))
    assert (array(matrix.randomize(spark, 500, 2, 1)) == r).all() and abs(r).max() <= 3 and abs(r.mean()) < 0.3
    assert np.allclose(array(matrix.append_rows(f, g, 7)), np.vstack([m, n])) and array(matrix.resize_rows(f, 9, 3, 7)).shape == (9, 3) and array(matrix.resize_rows(f, 2, 3, 7)).shape == (2, 3)
    assert array(matrix.resize_cols(f, 5)).shape == (7, 5)
    rhs = draw.normal(size=(4, 3))
    grams = [m.T @ m, n.T @ n]
    assert np.allclose(array(matrix.solve_normals(frame(spark, rhs), grams, 0)) @ grams[1], rhs)
    assert np.isfinite(matrix.inverse(np.ones((3, 3)))).all()
    fs, lam = matrix.final_lambda([f, g], [1.0, 2.0, 3.0], 3)
    assert np.allclose(lam, np.array([1, 2, 3]) * np.linalg.norm(m, axis=0) * np.linalg.norm(n, axis=0)) and np.allclose(np.linalg.norm(array(fs[0]), axis=0), 1)


def test_vectors(spark):
    v = F.array(F.lit(3), F.lit(1), F.lit(2))
    row = spark.range(1).select(vectors.append(v, 9).alias("a"), vectors.append_vector(v, v).alias("b"), vectors.resize(v, 5, 0).alias("c"), vectors.resize(v, 2, 0).alias("d"), vectors.largest(v).alias("e"), vectors.dump(v, "%d").alias("f"), vectors.constant(1.5, 2).alias("g")).first()
    assert tuple(row) == ([3, 1, 2, 9], [3, 1, 2, 3, 1, 2], [3, 1, 2, 0, 0], [3, 1], 3, "3\n1\n2", [1.5, 1.5])
    pairs = spark.sql("SELECT array(named_struct('key', 1, 'value', 5), named_struct('key', 2, 'value', 3)) AS p").select(vectors.sort_pairs(F.col("p"))).first()[0]
    assert [p["key"] for p in pairs] == [2, 1]


@pytest.mark.parametrize("blocked", [False, True])
def test_cpd(spark, blocked):
    """A fixed case of rank 2: X[i,j,k] = 3j + k + 1."""
    a = np.broadcast_to(np.arange(1.0, 10).reshape(1, 3, 3), (3, 3, 3))
    x = sparse(spark, a)
    k = cpd_als(hicoo.to_hicoo(x, 1, 1) if blocked else x, 2, 5, 1e-9)
    assert k.fit > 0.999
    fs = [array(f) for f in k.factors]
    assert np.allclose(np.einsum("r,ir,jr,kr->ijk", k.lam, *fs), a, atol=0.05)
    assert k.dump().startswith("nmodes: 3, rank: 2") and len(k.dump().splitlines()) == 17
    maps = order.random_maps(spark, (3, 3, 3), 2)
    moved = k.inverse_shuffle(maps)
    new = {(r["mode"], r["old"]): r["new"] for r in maps.collect()}
    assert np.allclose(array(moved.factors[1]), [fs[1][new[1, i]] for i in range(3)])


@pytest.mark.parametrize("rank", [2, 3])
def test_cpd_replayed(spark, a, rank, monkeypatch):
    """Every factor, lambda and the fit against the same iterations in numpy, with both ways to sum a Gram matrix."""
    us = [array(matrix.randomize(spark, d, rank, 5 + k)) for k, d in enumerate(DIMS)]
    lam, fit, subs = np.ones(rank), 0.0, ("jr,kr->ir", "ir,kr->jr", "ir,jr->kr")
    for it in range(3):
        for m in range(3):
            others = [u for k, u in enumerate(us) if k != m]
            product = np.einsum(f"ijk,{subs[m]}", a, *others)
            solved = product @ np.linalg.inv((others[0].T @ others[0]) * (others[1].T @ others[1]))
            lam = np.linalg.norm(solved, axis=0) if it == 0 else np.maximum(1, solved.max(0))
            us[m] = solved / lam
        model = np.einsum("r,ir,jr,kr->ijk", lam, *us)
        fit = 1 - np.linalg.norm(a - model) / np.linalg.norm(a)
    norms = [np.linalg.norm(u, axis=0) for u in us]
    if rank == 3:
        monkeypatch.setattr(matrix, "GRAM_WIDE", 2)
    k = cpd_als(sparse(spark, a), rank, 3, 0.0, seed=5)
    assert k.fit == pytest.approx(fit, abs=1e-8) and np.allclose(k.lam, lam * np.prod(norms, axis=0))
    assert all(np.allclose(array(f), u / n) for f, u, n in zip(k.factors, us, norms))


def test_fit_parts(spark, a):
    draw = np.random.default_rng(4)
    us, lam = [draw.normal(size=(d, 2)) for d in DIMS], [1.5, 0.5]
    model = np.einsum("r,ir,jr,kr->ijk", lam, *us)
    fs = [frame(spark, u) for u in us]
    inner = inner_df(fs[2], products.mttkrp(sparse(spark, a), fs, 2, 2), lam, DIMS[2]).first()[0]
    grams = [u.T @ u for u in us]
    assert inner == pytest.approx((a * model).sum()) and model_norm_squared(lam, grams) == pytest.approx((model**2).sum())
    assert fit_of((a**2).sum(), (model**2).sum(), inner) == pytest.approx(1 - np.linalg.norm(a - model) / np.linalg.norm(a))


def test_tucker(spark):
    draw = np.random.default_rng(8)
    a = np.einsum("pqr,ip,jq,kr->ijk", draw.normal(size=(2, 2, 2)), *(draw.normal(size=(d, 2)) for d in DIMS))
    core, fs = tucker(sparse(spark, a), (2, 2, 2))
    assert np.allclose(np.einsum("pqr,ip,jq,kr->ijk", dense(core), *(array(f) for f in fs)), a, atol=1e-6)


def test_text(spark, a, tmp_path):
    x = sparse(spark, a)
    text.write_tns(x, f"{tmp_path}/t")
    y = text.read_tns(spark, f"{tmp_path}/t")
    assert y.ndims == DIMS and (dense(y) == a).all()
    (tmp_path / "e.tns").write_text("2\n3 3\n1 1 1.0000000000000000e+00\n3 2\t-2\n2 2 0\n")
    assert text.read_tns(spark, f"{tmp_path}/e.tns").entries() == [(0, 0, 1.0), (2, 1, -2.0)]
    (tmp_path / "plain.tns").write_text("0 0 5\n1 1 6\n")
    assert text.read_tns(spark, f"{tmp_path}/plain.tns", 0, (2, 2)).entries() == [(0, 0, 5.0), (1, 1, 6.0)]
    (tmp_path / "bad.tns").write_text("2\n3 3\n1 1 1\n1 x 1\n0 1 1\n1 1\n2 2 2\n")
    assert text.read_tns(spark, f"{tmp_path}/bad.tns", strict=False).entries() == [(0, 0, 1.0), (1, 1, 2.0)]
    with pytest.raises(Exception, match="malformed"):
        text.read_tns(spark, f"{tmp_path}/bad.tns").entries()
    (tmp_path / "head.tns").write_text("1 2 3\n")
    with pytest.raises(TensorValueError):
        text.read_tns(spark, f"{tmp_path}/head.tns")
    (tmp_path / "m.txt").write_text("2 2 2\n1 2\n3 4\n")
    m, rows, cols = text.read_matrix_transposed(spark, f"{tmp_path}/m.txt")
    assert (array(m) == [[1, 3], [2, 4]]).all() and (rows, cols) == (2, 2)
    (tmp_path / "maps.txt").write_text("2 1 3\n1\n2")
    assert sorted(map(tuple, text.read_maps(spark, f"{tmp_path}/maps.txt", (3, 2)).collect())) == [(0, 0, 1), (0, 1, 0), (0, 2, 2), (1, 0, 0), (1, 1, 1)]
    (tmp_path / "many").mkdir()
    new = np.random.default_rng(1).permutation(900)
    for part in range(3):
        words = [str(w + 1) for w in new[part * 300 : part * 300 + 300]]
        lines = [" ".join(words[at : at + 7]) for at in range(0, 300, 7)]
        (tmp_path / "many" / f"{part}.txt").write_text("\n\n".join(lines))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        assert [r["new"] for r in text.read_maps(spark, f"{tmp_path}/many", (900,)).orderBy("old").collect()] == new.tolist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "short.txt").write_text("2 2")
    with pytest.raises(TensorValueError):
        text.read_matrix_transposed(spark, f"{tmp_path}/short.txt")
    text.write_matrix(m, f"{tmp_path}/out", 2, 2)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["2 x 2 matrix", "1.00\t3.00", "2.00\t4.00"]
    assert [r["line"] for r in text.show_vector(spark.createDataFrame([(1, 2.5), (0, 1.5)], "pos int, v double"), "%.1f").collect()] == ["1.5", "2.5"]


def test_generators(spark):
    x = generate.random_tensor(spark, (30, 20, 10), 0.1, 7)
    assert 450 < x.nnz < 650 and x.entries() == generate.random_tensor(spark, (30, 20, 10), 0.1, 7).entries()
    x.check_bounds()
    values = np.array([r[-1] for r in x.entries()])
    assert abs(values.mean()) < 0.2 and 0.8 < values.std() < 1.2
    cells = {tuple(r[:-1]) for r in generate.diagonal_tensor(spark, 28).entries()}
    assert cells == {(i, i + a, i + b) for i in range(28) for a, b in ((-3, 0), (0, -3), (0, 0), (0, 3), (3, 0)) if 0 <= i + a < 28 and 0 <= i + b < 28}
    rated = generate.rated_tensor(spark, [(1, 6), (0.25, 10), (0.5, 4)], 3)
    assert rated.entries() == generate.rated_tensor(spark, [(1, 6), (0.25, 10), (0.5, 4)], 3).entries() and len({r[:-1] for r in map(tuple, rated.entries())}) == rated.nnz
    drawn = [len({r[1] for r in rated.entries() if r[0] == k}) for k in range(6)]
    assert {*drawn} <= {2, 3} and rated.nnz == 2 * sum(drawn)
    assert 0.6 < reduce.density(generate.random_tensor(spark, (20, 20), 0.7)) < 0.8


def test_from_dataframe(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0), (None, 0, 9.0), (1, 1, None)], "a int, b int, c double")
    x = SparseTensor.from_dataframe(df, ["a", F.col("b")], "c")
    assert x.ndims == (3, 2) and x.entries() == [(0, 1, 5.0), (2, 0, 1.0)]
    assert SparseTensor.from_dataframe(df, ["a", "b"], "c", how="count").entries() == [(0, 1, 2.0), (2, 0, 1.0)]
    assert SparseTensor.from_dataframe(df.limit(0), ["a"], "c").entries() == []
    assert x.copy().entries() == x.entries() and x.nmodes == 2
