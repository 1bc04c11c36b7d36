"""The registered tensor queries and the SQL that gives the same rows."""

from __future__ import annotations

import uuid


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.keys import best_mode_order, worst_mode_order
from tensorloom.operators import dense_modes as dm
from tensorloom.operators import elementwise as el
from tensorloom.operators import hicoo as hi
from tensorloom.operators import matrix as mx
from tensorloom.operators import order as od
from tensorloom.operators import products as pr
from tensorloom.operators import ranges as rg
from tensorloom.operators import reduce as rd
from tensorloom.operators import reshape as rs
from tensorloom.operators import tiled as td
from tensorloom.plans.cpd import cpd_als, inner_df, model_norm_squared
from tensorloom.plans.tucker import tucker
from tensorloom.sources import text, tns, zorder
from tensorloom.sources.generate import diagonal_tensor, rated_tensor
from tensorloom.storage import shared_dir
from tensorloom.streaming import state as st
from tensorloom.streaming.accumulate import accumulate
from tensorloom.tensor import SemiSparseTensor, SparseTensor

RANK = 4
#: Columns of the embeddings.
WIDTH = 64


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d, where: str | None = None, modes=None, ndims=None) -> SparseTensor:
    rows, most = _table(spark, d, "lineitem"), None
    modes = modes or [F.col("l_suppkey"), F.col("l_linenumber") - 1, F.year("l_shipdate") - 1995]
    if ndims is None:
        *top, most = rows.agg(*(F.max(m.cast("bigint")) for m in modes), F.count("*")).first()
        ndims = tuple(x + 1 for x in top)
    out = SparseTensor.from_dataframe(rows.where(where) if where else rows, modes, "l_quantity", ndims)
    out.most = most
    return out


def x_of(spark, d) -> SparseTensor:
    """Quantity by supplier, line number and year."""
    return _lines(spark, d)


def y_of(spark, d, x: SparseTensor) -> SparseTensor:
    """The same, of returned lines only."""
    return _lines(spark, d, "l_returnflag = 'A'", ndims=x.ndims)


def s_of(spark, d) -> SparseTensor:
    """Quantity by supplier, part and line number: sparse."""
    return _lines(spark, d, modes=[F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber") - 1])


def e_of(spark, d) -> SparseTensor:
    """Events by user, type and day."""
    rows = _table(spark, d, "events")
    kinds = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1
    return SparseTensor.from_dataframe(rows, [F.col("user_id"), code, F.dayofmonth("ts") - 1], F.lit(1), how="count")


def u_of(spark, n: int, rank: int = RANK) -> DataFrame:
    """A factor with whole numbers, so that sums are exact in any order."""
    return spark.range(n).select(F.col("id").alias("row"), F.array(*(((F.col("id") * 7 + 3 * r) % 11 - 5).cast("double") for r in range(rank))).alias("vals"))


def _us(spark, x: SparseTensor, rank: int = RANK) -> list[DataFrame]:
    return [u_of(spark, n, rank) for n in x.ndims]


def _cells(y: SemiSparseTensor) -> DataFrame:
    return y.df.select(*y.rest, F.posexplode("fiber").alias("r", "v")).withColumn("r", F.col("r").cast("bigint"))


def _wide(a: DataFrame, rank: int = RANK) -> DataFrame:
    return a.select("row", *(F.col("vals")[r].alias(f"m{r}") for r in range(rank)))


_X = "x AS (SELECT l_suppkey::BIGINT AS i0, (l_linenumber - 1)::BIGINT AS i1, (year(l_shipdate) - 1995)::BIGINT AS i2, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
_Y = _X.replace("x AS", "y AS", 1).replace("FROM lineitem", "FROM lineitem WHERE l_returnflag = 'A'")
_S = "s AS (SELECT l_suppkey::BIGINT AS i0, l_partkey::BIGINT AS i1, (l_linenumber - 1)::BIGINT AS i2, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
_E = "e AS (SELECT user_id::BIGINT AS i0, (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS i1, (day(ts) - 1)::BIGINT AS i2 FROM events), ec AS (SELECT i0, i1, i2, count(*)::DOUBLE AS v FROM e GROUP BY ALL)"
_DIM = "d AS (SELECT max(i0) + 1 AS d0, max(i1) + 1 AS d1, max(i2) + 1 AS d2 FROM x)"
_u = lambda i, r, more=0: f"(({i} * 7 + {3 * r} + 3 * {more}) % 11 - 5)"
_RANKS = f"k AS (SELECT a.r, b.r AS q FROM range({RANK}) a(r), range({RANK}) b(r))"
_HB = "b AS (SELECT i0 >> 4 AS k0, i1 >> 4 AS k1, i2 >> 4 AS k2, i0 >> 2 AS b0, i1 >> 2 AS b1, i2 >> 2 AS b2, count(*)::BIGINT AS nnz FROM s GROUP BY ALL)"
_K = "k AS (SELECT k0, k1, k2, sum(nnz)::BIGINT AS nnz, count(*)::BIGINT AS blocks, row_number() OVER (ORDER BY k0, k1, k2) - 1 AS kid FROM b GROUP BY k0, k1, k2), kp AS (SELECT *, coalesce(sum(nnz) OVER (ORDER BY kid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS kptr FROM k)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {_X} SELECT * FROM x")
def tensor_build(spark, d):
    return x_of(spark, d).df


@query(f"WITH {_E} SELECT * FROM ec")
def tensor_build_events(spark, d):
    return e_of(spark, d).df


@query(f"WITH {_X} SELECT * FROM x")
def tns_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/tns-{uuid.uuid4().hex}"
    text.write_tns(x_of(spark, d), path)
    return text.read_tns(spark, path).df


@query(f"WITH {_S} SELECT * FROM s")
def tns_source(spark, d):
    path = f"{shared_dir(spark)}/tns-{uuid.uuid4().hex}"
    tns.save(s_of(spark, d), path)
    return tns.load(spark, path, split_bytes=1 << 20).df


@query(f"WITH {_X} SELECT i0, i1, i2, concat_ws(chr(9), i0 + 1, i1 + 1, i2 + 1, printf('%.6f', v)) AS line FROM x")
def tns_dump(spark, d):
    return text.tns_lines(x_of(spark, d))


_BOTH = f"WITH {_X}, {_Y}"


@query(f"{_BOTH} SELECT i0, i1, i2, coalesce(x.v, 0) + coalesce(y.v, 0) AS v FROM x FULL JOIN y USING (i0, i1, i2) WHERE coalesce(x.v, 0) + coalesce(y.v, 0) <> 0")
def add(spark, d):
    x = x_of(spark, d)
    return (x + y_of(spark, d, x)).df


@query(f"{_BOTH} SELECT i0, i1, i2, coalesce(x.v, 0) - coalesce(y.v, 0) AS v FROM x FULL JOIN y USING (i0, i1, i2) WHERE coalesce(x.v, 0) - coalesce(y.v, 0) <> 0")
def sub(spark, d):
    x = x_of(spark, d)
    return (x - y_of(spark, d, x)).df


@query(f"{_BOTH} SELECT i0, i1, i2, x.v * y.v AS v FROM x JOIN y USING (i0, i1, i2)")
def hadamard_mul(spark, d):
    x = x_of(spark, d)
    return (x * y_of(spark, d, x)).df


@query(f"WITH {_X} SELECT i0, i1, i2, v * v AS v FROM x")
def hadamard_mul_eq(spark, d):
    x = x_of(spark, d)
    return el.dot_mul_eq(x, x).df


@query(f"{_BOTH} SELECT i0, i1, i2, x.v / y.v AS v FROM x JOIN y USING (i0, i1, i2)")
def hadamard_div(spark, d):
    x = x_of(spark, d)
    return (x / y_of(spark, d, x)).df


@query(f"{_BOTH} SELECT i0, i1, i2, y.v / x.v AS v FROM x JOIN y USING (i0, i1, i2)")
def hadamard_ldiv(spark, d):
    x = x_of(spark, d)
    return x.ldivide(y_of(spark, d, x)).df


@query(f"{_BOTH} SELECT x.* FROM x SEMI JOIN y USING (i0, i1, i2)")
def mask(spark, d):
    x = x_of(spark, d)
    return el.mask(x, y_of(spark, d, x)).df


@query(f"{_BOTH} SELECT x.* FROM x ANTI JOIN y USING (i0, i1, i2)")
def unmask(spark, d):
    x = x_of(spark, d)
    return el.unmask(x, y_of(spark, d, x)).df


@query(f"WITH {_X} SELECT i0, i1, i2, 3 * v AS v FROM x")
def scalar_mul(spark, d):
    return (3 * x_of(spark, d)).df


@query(f"WITH {_X} SELECT * FROM x WHERE false")
def scalar_mul_zero(spark, d):
    return (x_of(spark, d) * 0).df


@query(f"WITH {_X} SELECT i0, i1, i2, v / 4 AS v FROM x")
def scalar_div(spark, d):
    return (x_of(spark, d) / 4).df


@query("SELECT l_suppkey::BIGINT AS i0, l_partkey::BIGINT AS i1, l_orderkey::BIGINT AS i2, max(l_discount)::DOUBLE AS v FROM lineitem GROUP BY ALL HAVING max(l_discount) <> 0")
def collect_zeros(spark, d):
    rows = _table(spark, d, "lineitem")
    return el.collect_zeros(SparseTensor.from_dataframe(rows, ["l_suppkey", "l_partkey", "l_orderkey"], "l_discount", how="max")).df


@query(f"WITH {_X} SELECT sqrt(sum(v * v)) AS norm FROM x")
def norm(spark, d):
    return rd.norm_squared_df(x_of(spark, d)).select(F.sqrt("norm_sq").alias("norm"))


@query(f"WITH {_X} SELECT sum(v * v) AS norm_sq FROM x")
def norm_sq(spark, d):
    return rd.norm_squared_df(x_of(spark, d))


@query(f"WITH {_S} SELECT sum(v * v) AS norm_sq FROM s")
def norm_sq_hicoo(spark, d):
    return hi.norm_squared_df(hi.to_hicoo(s_of(spark, d), 2, 4))


@query(f"WITH {_X} SELECT sqrt(sum(v * v)) AS norm FROM x")
def norm_semisparse(spark, d):
    return rd.semi_norm_df(rs.to_semisparse(x_of(spark, d), 2))


@query(f"WITH {_X}, {_DIM} SELECT round(count(*) / any_value(d0 * d1 * d2), 9) AS density FROM x, d")
def density(spark, d):
    return rd.status_df(x_of(spark, d)).select(F.round("density", 9).alias("density"))


@query(f"WITH {_S.replace('s AS', 'x AS', 1)}, {_DIM} SELECT 3 AS nmodes, count(*)::BIGINT AS nnz, round(count(*) / any_value(d0 * d1 * d2), 9) AS density, (count(*) * 16)::BIGINT AS bytes, round(count(*) / any_value(d0), 6) AS s0, round(count(*) / any_value(d1), 6) AS s1, round(count(*) / any_value(d2), 6) AS s2 FROM x, d")
def status(spark, d):
    return rd.status_df(s_of(spark, d)).select("nmodes", "nnz", F.round("density", 9).alias("density"), "bytes", *(F.round(F.col("slice_len")[k], 6).alias(f"s{k}") for k in range(3)))


@query(f"WITH {_S} SELECT 0 AS mode, min(i0) AS low, max(i0) + 1 AS high FROM s UNION ALL SELECT 1, min(i1), max(i1) + 1 FROM s UNION ALL SELECT 2, min(i2), max(i2) + 1 FROM s")
def index_bounds(spark, d):
    return rd.index_bounds(s_of(spark, d))


@query(f"WITH {_S} SELECT idx, (SELECT count(*) FROM s WHERE i1 = idx)::BIGINT AS nnz FROM (SELECT unnest(range((SELECT max(i1) + 1 FROM s))) AS idx)")
def slice_sizes(spark, d):
    return rd.slice_sizes(s_of(spark, d), 1)


@query(f"WITH {_S} SELECT * FROM s WHERE i0 >= 10 AND i0 < 40 AND i1 >= 100 AND i1 < 900 AND i2 >= 1 AND i2 < 5")
def subtensor(spark, d):
    return rs.subtensor(s_of(spark, d), (10, 100, 1), (40, 900, 5)).df


@query(f"WITH {_X}, {_DIM} SELECT i1 AS row, i2 * d0 + i0 AS col, v FROM x, d")
def matricize_row(spark, d):
    return rs.matricize(x_of(spark, d), 1, 1)


@query(f"WITH {_X}, {_DIM} SELECT i1 * d2 + i2 AS row, i0 AS col, v FROM x, d")
def matricize_col(spark, d):
    return rs.matricize(x_of(spark, d), 0, 0)


@query(f"WITH {_X}, {_DIM}, f AS (SELECT DISTINCT i0, i1 FROM x), g AS (SELECT unnest(range((SELECT d2 FROM d))) AS r) SELECT f.i0, f.i1, g.r, coalesce(v, 0) AS v FROM f CROSS JOIN g LEFT JOIN x ON x.i0 = f.i0 AND x.i1 = f.i1 AND x.i2 = g.r")
def to_semisparse(spark, d):
    return _cells(rs.to_semisparse(x_of(spark, d), 2))


@query(f"WITH {_X} SELECT * FROM x")
def from_semisparse(spark, d):
    return rs.from_semisparse(rs.to_semisparse(x_of(spark, d), 2)).df


@query(f"WITH {_E}, f AS (SELECT DISTINCT i1, i2 FROM ec), g AS (SELECT unnest(range((SELECT max(i0) + 1 FROM ec))) AS r) SELECT f.i1, f.i2, g.r, coalesce(v, 0) AS v FROM f CROSS JOIN g LEFT JOIN ec ON ec.i1 = f.i1 AND ec.i2 = f.i2 AND ec.i0 = g.r")
def set_mode(spark, d):
    return _cells(rs.set_mode(rs.to_semisparse(e_of(spark, d), 2), 0))


@query(f"WITH {_X} SELECT i0, i1, i2, 2 * v AS v FROM x")
def merge_fibers(spark, d):
    y = rs.to_semisparse(x_of(spark, d), 2)
    return rs.from_semisparse(rs.merge_fibers(SemiSparseTensor(y.df.unionByName(y.df), y.ndims, y.mode))).df


@query(f"WITH {_X} SELECT i0, i1, i2, CASE WHEN i2 = 0 THEN 7 ELSE v END::DOUBLE AS v FROM x")
def semisparse_append(spark, d):
    x = x_of(spark, d)
    new = x.df.where("i2 = 0").withColumn("v", F.lit(7.0)).withColumn("seq", F.col("i0"))
    return rs.from_semisparse(rs.append(rs.to_semisparse(x, 2), new)).df


@query(f"WITH {_S}, f AS (SELECT i0, i1, count(*)::BIGINT AS nnz FROM s GROUP BY ALL) SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(nnz) OVER (ORDER BY i0, i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fiberidx FROM f WINDOW w AS (ORDER BY i0, i1)")
def fiber_index(spark, d):
    return rs.fiber_index(s_of(spark, d), 2)


@query(f"WITH {_X}, {_DIM}, f AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS row FROM (SELECT DISTINCT i0, i1 FROM x)), g AS (SELECT unnest(range((SELECT d2 FROM d))) AS col) SELECT f.row, f.row * d2 AS rowptr, g.col, coalesce(v, 0) AS v FROM f CROSS JOIN g CROSS JOIN d LEFT JOIN x ON x.i0 = f.i0 AND x.i1 = f.i1 AND x.i2 = g.col")
def csr(spark, d):
    rows = rs.to_csr(rs.to_semisparse(x_of(spark, d), 2))
    return rows.select("row", "rowptr", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("v"))))


@query("WITH m AS (SELECT user_id::BIGINT AS i0, (day(ts) - 1)::BIGINT AS i1, count(*)::DOUBLE AS v FROM events GROUP BY ALL), a AS (SELECT unnest(range((SELECT max(i0) + 1 FROM m))) AS row), b AS (SELECT unnest(range((SELECT max(i1) + 1 FROM m))) AS col) SELECT row, col::INT AS col, coalesce(v, 0) AS v FROM a CROSS JOIN b LEFT JOIN m ON i0 = row AND i1 = col")
def to_dense(spark, d):
    x = SparseTensor.from_dataframe(_table(spark, d, "events"), [F.col("user_id"), F.dayofmonth("ts") - 1], F.lit(1), how="count")
    return mx.exploded(rs.to_dense(x))


def _ttm_sql(x: str, t: str) -> str:
    return f"WITH {x} " + " UNION ALL ".join(f"SELECT i0, i2, {r}::BIGINT AS r, sum(v * {_u('i1', r)})::DOUBLE AS v FROM {t} GROUP BY i0, i2" for r in range(RANK))


@query(_ttm_sql(_S, "s"))
def ttm(spark, d):
    s = s_of(spark, d)
    return _cells(pr.ttm(s, u_of(spark, s.ndims[1]), 1, s.ndims[1], RANK))


@query(f"WITH {_S} SELECT i0, i2, sum(v * (i1 % 5 - 2))::DOUBLE AS v FROM s GROUP BY i0, i2")
def ttv(spark, d):
    s = s_of(spark, d)
    w = spark.range(s.ndims[1]).select(F.col("id").alias("pos"), (F.col("id") % 5 - 2).cast("double").alias("v"))
    y = pr.ttv(s, w, 1, s.ndims[1])
    return y.df.select(*y.rest, F.col("fiber")[0].alias("v"))


@query(f"WITH {_S}, {_RANKS} SELECT i0, r AS i1, q AS i2, sum(v * {_u('i1', 0, 'r')} * {_u('i2', 0, 'q')})::DOUBLE AS v FROM s, k GROUP BY ALL HAVING sum(v * {_u('i1', 0, 'r')} * {_u('i2', 0, 'q')}) <> 0")
def blocks_ttm_chain(spark, d):
    """Two modes times a matrix each: the sparse one becomes dense beside the one that is, and both stay in blocks."""
    s = s_of(spark, d)
    y = dm.to_blocks(s, [2])
    for m in (1, 2):
        y = dm.ttm(y, u_of(spark, s.ndims[m]), m, s.ndims[m], RANK)
    return dm.from_blocks(y).df


@query(f"WITH {_X} SELECT i0, i1, i2, 3 * v AS v FROM x")
def blocks_roundtrip(spark, d):
    y = dm.to_blocks(x_of(spark, d), [2, 1])
    return dm.from_blocks(dm.add(y, dm.scale(y, 2))).df


@query(_ttm_sql(_X, "x"))
def sttm(spark, d):
    x = x_of(spark, d)
    return _cells(pr.sttm(rs.to_semisparse(x, 1), u_of(spark, x.ndims[1]), 1, x.ndims[1], RANK))


def _mttkrp_sql(x: str, t: str, m: int, rank: int = RANK, n: int = 3) -> str:
    rest = [k for k in range(n) if k != m]
    sums = ", ".join(f"sum(v * {' * '.join(_u(f'i{k}', r) for k in rest)})::DOUBLE AS m{r}" for r in range(rank))
    cols = ", ".join(f"coalesce(m{r}, 0) AS m{r}" for r in range(rank))
    return f"WITH {x}, g AS (SELECT i{m} AS row, {sums} FROM {t} GROUP BY i{m}), a AS (SELECT unnest(range((SELECT max(i{m}) + 1 FROM {t}))) AS row) SELECT a.row, {cols} FROM a LEFT JOIN g USING (row)"


def _mttkrp(m: int):
    def run(spark, d):
        s = s_of(spark, d)
        return _wide(pr.mttkrp(s, _us(spark, s), m, RANK))

    return run


for _m in range(3):
    Q[f"mttkrp_m{_m}"], SQL[f"mttkrp_m{_m}"] = _mttkrp(_m), _mttkrp_sql(_S, "s", _m)

_S4 = "s AS (SELECT l_suppkey::BIGINT AS i0, l_partkey::BIGINT AS i1, (l_linenumber - 1)::BIGINT AS i2, (year(l_shipdate) - 1995)::BIGINT AS i3, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"


@query(_mttkrp_sql(_S4, "s", 0, RANK, 4))
def mttkrp_4d(spark, d):
    s = _lines(spark, d, modes=[F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber") - 1, F.year("l_shipdate") - 1995])
    return _wide(pr.mttkrp(s, _us(spark, s), 0, RANK))


@query(_mttkrp_sql(_S, "s", 1, 16))
def mttkrp_r16(spark, d):
    s = s_of(spark, d)
    return _wide(pr.mttkrp(s, _us(spark, s, 16), 1, 16), 16)


@query(_mttkrp_sql(_S, "s", 0))
def hicoo_mttkrp(spark, d):
    h = hi.to_hicoo(s_of(spark, d), 2, 4)
    return _wide(hi.hicoo_mttkrp(h, [u_of(spark, n) for n in h.ndims], 0, RANK))


@query(_mttkrp_sql(_S, "s", 0))
def hicoo_mttkrp_scheduled(spark, d):
    h = hi.to_hicoo(s_of(spark, d), 2, 4)
    return _wide(hi.hicoo_mttkrp_scheduled(h, [u_of(spark, n) for n in h.ndims], 0, RANK))


#: Blocks of 128 and kernels of 1024 indices, the format's usual sizes.
_USUAL = (7, 10)


@query(_mttkrp_sql(_S, "s", 0, 16))
def hicoo_mttkrp_tiled(spark, d):
    h = hi.to_hicoo(s_of(spark, d), *_USUAL)
    return _wide(td.hicoo_mttkrp_tiled(h, [u_of(spark, n, 16) for n in h.ndims], 0, 16), 16)


@query(_mttkrp_sql(_S, "s", 2))
def hicoo_mttkrp_balanced(spark, d):
    h = hi.to_hicoo(s_of(spark, d), *_USUAL)
    return _wide(td.hicoo_mttkrp_balanced(h, [u_of(spark, n) for n in h.ndims], 2, RANK))


def _small(spark, d) -> tuple[SparseTensor, SparseTensor]:
    """All lines' quantities and numbers by year, line number and return flag: small by nature, however many lines."""
    rows = _table(spark, d, "lineitem")
    modes = [F.year("l_shipdate") - 1995, F.col("l_linenumber") - 1, F.ascii("l_returnflag") - 65]
    ndims = tuple(x + 1 for x in rows.agg(*(F.max(m.cast("bigint")) for m in modes)).first())
    return SparseTensor.from_dataframe(rows, modes, "l_quantity", ndims), SparseTensor.from_dataframe(rows, modes, F.lit(1), ndims, how="count")


_SMALL = (
    "t AS (SELECT (year(l_shipdate) - 1995)::BIGINT AS i0, (l_linenumber - 1)::BIGINT AS i1, (ascii(l_returnflag) - 65)::BIGINT AS i2, sum(l_quantity)::DOUBLE AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), "
    "d AS (SELECT max(i0) + 1 AS d0, max(i1) + 1 AS d1, max(i2) + 1 AS d2 FROM t)"
)


@query(f"WITH {_SMALL} SELECT a.i0 * d0 + c.i0 AS i0, a.i1 * d1 + c.i1 AS i1, i2, a.v * c.n AS v FROM t a JOIN t c USING (i2), d")
def khatri_rao(spark, d):
    return pr.khatri_rao(*_small(spark, d)).df


@query(f"WITH {_SMALL} SELECT a.i0 * d0 + c.i0 AS i0, a.i1 * d1 + c.i1 AS i1, a.i2 * d2 + c.i2 AS i2, a.v * c.n AS v FROM t a, t c, d")
def kronecker(spark, d):
    return pr.kronecker(*_small(spark, d)).df


def _sorted(name: str, keys, sql: str) -> None:
    def run(spark, d):
        s = s_of(spark, d)
        return od.with_pos(s.df, keys(s))

    Q[name], SQL[name] = run, f"WITH {_S} SELECT *, row_number() OVER (ORDER BY {sql}) - 1 AS pos FROM s"


def _morton_sql(bits: int, of: str = "i") -> str:
    return "(" + " | ".join(f"((({of}{k} >> {b}) & 1) << {3 * b + 2 - k})" for b in range(bits) for k in range(3)) + ")"


_sorted("sort_lexi", lambda s: s.modes, "i0, i1, i2")
_sorted("sort_at_mode", lambda s: ["i0", "i2", "i1"], "i0, i2, i1")
_sorted("sort_custom", lambda s: ["i2", "i0", "i1"], "i2, i0, i1")
_sorted("sort_except_mode", lambda s: [*od.except_mode_keys(s, 1), "i1"], "i0, i2, i1")
_sorted("sort_rowblock", lambda s: [*od.rowblock_keys(s, 3), *s.modes], "i0 >> 3, i1 >> 3, i2 >> 3, i0, i1, i2")
# Indices from 2^20 on share the 20 bits of others: the modes settle their order.
_sorted("sort_morton", lambda s: [*od.morton_keys(s, 20), *s.modes], _morton_sql(20))
_sorted("sort_mixed", lambda s: [*od.rowblock_keys(s, 3), *od.morton_keys(s)], f"i0 >> 3, i1 >> 3, i2 >> 3, {_morton_sql(20)}")
_sorted("sort_partial", lambda s: [*od.partial_keys(s, [1, 0, 2], 3), *s.modes], "i1, i1 >> 3, i0 >> 3, i2 >> 3, i0, i1, i2")


@query(f"WITH {_S}, d AS (SELECT max(i0) + 1 AS d0, max(i1) + 1 AS d1, max(i2) + 1 AS d2 FROM s), m AS (SELECT unnest([0, 1, 2]) AS mode, unnest([d0, d1, d2]) AS n FROM d) SELECT 'best' AS kind, (row_number() OVER (ORDER BY mode <> 1, n, mode) - 1)::INT AS place, mode FROM m UNION ALL SELECT 'worst', (row_number() OVER (ORDER BY mode = 1, n DESC, mode) - 1)::INT, mode FROM m")
def mode_order(spark, d):
    n = s_of(spark, d).ndims
    rows = [(kind, place, mode) for kind, f in (("best", best_mode_order), ("worst", worst_mode_order)) for place, mode in enumerate(f(n, 1))]
    return spark.createDataFrame(rows, "kind string, place int, mode int")


def _shift_maps(spark, ndims) -> DataFrame:
    out = None
    for k, n in enumerate(ndims):
        one = spark.range(n).select(F.lit(k).alias("mode"), F.col("id").alias("old"), ((F.col("id") + 3) % n).alias("new"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_X}, {_DIM} SELECT (i0 + 3) % d0 AS i0, (i1 + 3) % d1 AS i1, (i2 + 3) % d2 AS i2, v FROM x, d")
def relabel(spark, d):
    x = x_of(spark, d)
    return rs.relabel(x, _shift_maps(spark, x.ndims)).df


@query(f"WITH {_X} SELECT * FROM x")
def invert_map(spark, d):
    x = x_of(spark, d)
    maps = od.random_maps(spark, x.ndims, 5)
    return rs.relabel(rs.relabel(x, maps), rs.invert_map(maps)).df


@query(f"WITH {_E}, t AS (SELECT i1, i2, row_number() OVER (ORDER BY i1, i2) - 1 AS p FROM (SELECT DISTINCT i1, i2 FROM ec)), r AS (SELECT i0, list_sort(list(p)) AS l FROM ec JOIN t USING (i1, i2) GROUP BY i0), a AS (SELECT unnest(range((SELECT max(i0) + 1 FROM ec))) AS old) SELECT 0 AS mode, old, row_number() OVER (ORDER BY list_append(coalesce(l, []), 9223372036854775807), old) - 1 AS new FROM a LEFT JOIN r ON old = i0")
def lexi_order(spark, d):
    return od.lexi_order(e_of(spark, d), 0)


@query()
def bfs_order(spark, d):
    return od.bfs_order(s_of(spark, d), 0)


@query()
def mcs_order(spark, d):
    return od.mcs_order(s_of(spark, d), 0)


@query(f"WITH {_S}, {_HB} SELECT * FROM b")
def hicoo_blocks(spark, d):
    return hi.to_hicoo(s_of(spark, d), 2, 4).df.drop("elems")


@query(f"WITH {_S} SELECT * FROM s")
def hicoo_roundtrip(spark, d):
    return hi.to_coo(hi.to_hicoo(s_of(spark, d), 2, 4)).df


@query(f"WITH {_S}, {_HB}, {_K} SELECT k0, k1, k2, nnz, blocks, kid, kptr FROM kp")
def hicoo_kernels(spark, d):
    return hi.kernel_pointers(hi.to_hicoo(s_of(spark, d), 2, 4))


_BP = (
    "bp AS (SELECT kid, row_number() OVER w - 1 AS bid, b0, b1, b2, b.nnz, coalesce(sum(b.nnz) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bptr "
    f"FROM b JOIN kp USING (k0, k1, k2) WINDOW w AS (ORDER BY kid, {_morton_sql(20, 'b')}))"
)


@query(f"WITH {_S}, {_HB}, {_K}, {_BP} SELECT * FROM bp")
def hicoo_bptr(spark, d):
    return hi.block_pointers(hi.to_hicoo(s_of(spark, d), 2, 4))


def _chunks(bits: int) -> str:
    """Block by block within each kernel: s says that a chunk starts there, n how much it holds so far."""
    return (
        "n AS (SELECT kid, bid, nnz, row_number() OVER (PARTITION BY kid ORDER BY bid) AS k FROM bp), "
        f"c AS (SELECT kid, bid, k, true AS s, nnz AS n FROM n WHERE k = 1 UNION ALL SELECT n.kid, n.bid, n.k, c.n >= {1 << bits}, CASE WHEN c.n >= {1 << bits} THEN 0 ELSE c.n END + n.nnz FROM c JOIN n ON n.kid = c.kid AND n.k = c.k + 1)"
    )


@query(f"WITH RECURSIVE {_S}, {_HB}, {_K}, {_BP}, {_chunks(4)} SELECT kid, (row_number() OVER (PARTITION BY kid ORDER BY bid) - 1)::INT AS cid, bid AS first_block FROM c WHERE s")
def hicoo_chunks(spark, d):
    return hi.chunk_pointers(hi.to_hicoo(s_of(spark, d), 2, 4), 4)


@query(f"WITH {_S}, {_HB}, {_K} " + " UNION ALL ".join(f"SELECT {m} AS mode, k{m} AS k, row_number() OVER (PARTITION BY k{m} ORDER BY kid) - 1 AS place, kid FROM kp" for m in range(3)))
def hicoo_schedule(spark, d):
    return hi.schedule(hi.to_hicoo(s_of(spark, d), 2, 4))


_STATUS = (
    "q AS (SELECT count(*)::BIGINT AS nb, count(DISTINCT (k0, k1, k2))::BIGINT AS nk, sum(nnz)::BIGINT AS nnz, max(nnz) AS max_nnzb, min(nnz) AS min_nnzb, (sum(nnz) // count(*))::BIGINT AS avg_nnzb, "
    "quantile_disc(nnz, 0.5)::BIGINT AS median_nnzb, round(exp(avg(ln(nnz / 4.0::DOUBLE))), 6) AS geo_mean, round(count(*) / sum(nnz)::DOUBLE, 6) AS alpha_b FROM b), "
    "m AS (SELECT count(*)::BIGINT AS nc FROM c WHERE s), "
    "w AS (SELECT " + ", ".join(f"(SELECT max(n) FROM (SELECT count(*)::BIGINT AS n FROM kp GROUP BY k{k})) AS kiters{k}, (SELECT (max(i{k}) >> 4) + 1 FROM s) AS kdim{k}" for k in range(3)) + ")"
)


@query(f"WITH RECURSIVE {_S}, {_HB}, {_K}, {_BP}, {_chunks(14)}, {_STATUS} SELECT *, (nnz * 7 + nb * 12 + (nb + nk + nc + 3) * 8 + nk * 12 + (kdim0 + kdim1 + kdim2 + 3) * 8 + 12)::BIGINT AS bytes FROM q, m, w")
def hicoo_status(spark, d):
    return hi.status(hi.to_hicoo(s_of(spark, d), 2, 4))


def _emb(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("vals"))


@query(f"SELECT p::INT AS p, q::INT AS q, round(sum(embedding[p + 1]::DOUBLE * embedding[q + 1]::DOUBLE), 6) AS v FROM embeddings, range({WIDTH}) a(p), range({WIDTH}) b(q) WHERE p <= q GROUP BY p, q")
def gram(spark, d):
    return mx.gram_entries(_emb(spark, d), WIDTH).select("p", "q", F.round("v", 6).alias("v"))


@query("SELECT " + ", ".join(f"round(sqrt(sum(embedding[{p + 1}]::DOUBLE ** 2)), 6) AS l{p}" for p in range(WIDTH)) + " FROM embeddings")
def col_norm2(spark, d):
    return mx.col_norms_df(_emb(spark, d), WIDTH).select(*(F.round(F.col("lambda")[p], 6).alias(f"l{p}") for p in range(WIDTH)))


@query("SELECT " + ", ".join(f"greatest(1, max(embedding[{p + 1}]::DOUBLE))::DOUBLE AS l{p}" for p in range(WIDTH)) + " FROM embeddings")
def col_maxnorm(spark, d):
    return mx.col_maxima_df(_emb(spark, d), WIDTH).select(*(F.col("lambda")[p].alias(f"l{p}") for p in range(WIDTH)))


@query("SELECT vec_id AS row, " + ", ".join(f"embedding[{p + 1}]::DOUBLE * embedding[{p + 1}]::DOUBLE AS m{p}" for p in range(WIDTH)) + " FROM embeddings")
def matrix_dot_mul(spark, d):
    return _wide(mx.dot_mul(_emb(spark, d), _emb(spark, d)), WIDTH)


def _gram_sql(n: str, p: int, q: int) -> str:
    return f"(SELECT sum({_u('i', p)} * {_u('i', q)}) FROM (SELECT unnest(range({n})) AS i))"


@query(f"WITH {_X}, {_DIM} SELECT " + ", ".join(f"({_gram_sql('(SELECT d0 FROM d)', p, q)} * {_gram_sql('(SELECT d2 FROM d)', p, q)})::DOUBLE AS h_{p}_{q}" for p in range(2) for q in range(p, 2)))
def hadamard_grams(spark, d):
    x = x_of(spark, d)
    h = mx.hadamard_grams([mx.gram(u, 2) for u in _us(spark, x, 2)], 1)
    return spark.createDataFrame([(float(h[0, 0]), float(h[0, 1]), float(h[1, 1]))], "h_0_0 double, h_0_1 double, h_1_1 double")


@query(
    f"WITH {_S}, d AS (SELECT max(i1) + 1 AS d1, max(i2) + 1 AS d2 FROM s), "
    + "g AS (SELECT " + ", ".join(f"({_gram_sql('(SELECT d1 FROM d)', p, q)} * {_gram_sql('(SELECT d2 FROM d)', p, q)})::DOUBLE AS h{p}{q}" for p in range(2) for q in range(p, 2)) + "), "
    + "m AS (SELECT i0 AS row, " + ", ".join(f"sum(v * {_u('i1', r)} * {_u('i2', r)})::DOUBLE AS m{r}" for r in range(2)) + " FROM s GROUP BY i0) "
    + "SELECT row, round((m0 * h11 - m1 * h01) / (h00 * h11 - h01 * h01), 6) AS m0, round((m1 * h00 - m0 * h01) / (h00 * h11 - h01 * h01), 6) AS m1 FROM m, g"
)
def als_half_step(spark, d):
    s = s_of(spark, d)
    us = _us(spark, s, 2)
    solved = mx.solve_normals(pr.mttkrp(s, us, 0, 2, dense=False), [mx.gram(u, 2) for u in us], 0)
    return solved.select("row", *(F.round(F.col("vals")[r], 6).alias(f"m{r}") for r in range(2)))


@query()
def cpd_als_coo(spark, d):
    k = cpd_als(s_of(spark, d), 4, 3)
    return spark.createDataFrame([(r, float(x), float(k.fit)) for r, x in enumerate(k.lam)], "r int, lam double, fit double")


@query()
def cpd_als_hicoo(spark, d):
    k = cpd_als(hi.to_hicoo(s_of(spark, d), 2, 4), 4, 3)
    return spark.createDataFrame([(r, float(x), float(k.fit)) for r, x in enumerate(k.lam)], "r int, lam double, fit double")


@query()
def tucker_core(spark, d):
    """Norms of the tensor and of its core, and what the core explains."""
    x = x_of(spark, d)
    core, _ = tucker(x, (3, 3, 3), 2)
    whole = rd.norm_squared_df(x).select(F.sqrt("norm_sq").alias("norm"))
    part = rd.norm_squared_df(core).select(F.sqrt("norm_sq").alias("core_norm"))
    return whole.crossJoin(part).withColumn("explained", F.pow(F.col("core_norm") / F.col("norm"), 2))  # a row each


_INNER = " + ".join(f"(SELECT coalesce(sum(v * {_u('i0', r)} * {_u('i1', r)} * {_u('i2', r)}), 0) * {r + 1} FROM s)" for r in range(RANK))


@query(f"WITH {_S} SELECT ({_INNER})::DOUBLE AS \"inner\"")
def kruskal_inner(spark, d):
    s = s_of(spark, d)
    us = _us(spark, s)
    return inner_df(us[2], pr.mttkrp(s, us, 2, RANK), [1.0, 2.0, 3.0, 4.0], s.ndims[2])


@query(f"WITH {_S}, c AS (SELECT i0, i2, sum(v) AS v FROM s WHERE i0 + 1 >= 5 AND i0 + 1 < 50 GROUP BY ALL) SELECT i0, i2 AS i1, v FROM c WHERE v <> 0")
def crop(spark, d):
    return rs.crop(s_of(spark, d), ["5:50", "-", ":"]).df


_O = "o AS (SELECT l_orderkey::BIGINT AS i0, (l_partkey * 3)::BIGINT AS i1, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"


@query(f"WITH {_O} SELECT dense_rank() OVER (ORDER BY i0) - 1 AS i0, dense_rank() OVER (ORDER BY i1) - 1 AS i1, v FROM o")
def reindex(spark, d):
    return rs.reindex(_lines(spark, d, modes=[F.col("l_orderkey"), F.col("l_partkey") * 3])).df


@query(
    f"WITH {_S}, t AS (SELECT i0, sum(v) AS v FROM s GROUP BY i0), n AS (SELECT max(i0) + 1 AS n FROM s), r AS (SELECT unnest(range(n)) AS i, n FROM n), "
    "w AS (SELECT i, n, i + x * floor(n ** (1 / 3::DOUBLE))::BIGINT AS p, i + y * floor(n ** (1 / 3::DOUBLE))::BIGINT AS q FROM r, (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) o(x, y)) "
    "SELECT i AS i0, p AS i1, q AS i2, v FROM w JOIN t ON i0 = i WHERE p BETWEEN 0 AND n - 1 AND q BETWEEN 0 AND n - 1"
)
def diagonal(spark, d):
    """The stencil over the suppliers, with each supplier's quantity for its random values."""
    s = s_of(spark, d)
    by = s.df.groupBy("i0").agg(F.sum("v").alias("v"))
    return diagonal_tensor(spark, s.ndims[0]).df.drop("v").join(by, "i0")


@query("SELECT user_id::BIGINT AS i0, 15::BIGINT AS n, count(*)::BIGINT AS events FROM events GROUP BY user_id")
def generated_rates(spark, d):
    """Entries by user, beside the user's events: every one draws half of 10 and, for each of these, 3 of 30."""
    events = _table(spark, d, "events").groupBy(F.col("user_id").cast("bigint").alias("i0")).agg(F.count("*").alias("events"))
    users = events.agg(F.max("i0")).first()[0] + 1
    made = rated_tensor(spark, [(1.0, users), (0.5, 10), (0.1, 30)]).df.groupBy("i0").agg(F.count("*").alias("n"))
    return made.join(events, "i0")


@query(f"WITH {_X} SELECT i0, i1, i2, sum(v) AS v FROM x GROUP BY CUBE (i0, i1, i2)")
def marginals(spark, d):
    return rd.marginals(x_of(spark, d))


@query(f"WITH {_S} SELECT * FROM s ORDER BY abs(v) DESC, i0, i1, i2 LIMIT 20")
def top_k(spark, d):
    return rd.top_k(s_of(spark, d), 20).df


@query("SELECT vec_id AS row, array_to_string([printf('%.2f', embedding[k]::DOUBLE) for k in range(1, 65)], chr(9)) AS line FROM embeddings")
def matrix_dump(spark, d):
    return text.matrix_lines(_emb(spark, d))




@query(f"WITH {_S} SELECT * FROM s ORDER BY i0, i1, i2 LIMIT 1 OFFSET 100")
def nth_entry(spark, d):
    return rs.nth_entry(s_of(spark, d), 100)


@query(f"SELECT p::INT AS p, q::INT AS q, CASE WHEN p = q THEN round(sum(embedding[p + 1]::DOUBLE * embedding[q + 1]::DOUBLE), 6) ELSE 0 END AS v FROM embeddings, range({WIDTH}) a(p), range({WIDTH}) b(q) WHERE p <= q GROUP BY p, q")
def identity_matrix(spark, d):
    """The Gram matrix of the embeddings times the identity, place by place."""
    ones = mx.exploded(mx.identity(spark, WIDTH)).select(F.col("row").cast("int").alias("p"), F.col("col").alias("q"), F.col("v").alias("one"))
    return mx.gram_entries(_emb(spark, d), WIDTH).join(ones, ["p", "q"]).select("p", "q", F.round(F.col("v") * F.col("one"), 6).alias("v"))


@query("SELECT (SELECT count(*) FROM embeddings) - 1 - vec_id AS row, " + ", ".join(f"embedding[{p + 1}]::DOUBLE AS m{p}" for p in range(WIDTH)) + " FROM embeddings")
def matrix_inverse_shuffle(spark, d):
    a = _emb(spark, d)
    n = a.count()
    maps = spark.range(n).select(F.lit(0).alias("mode"), (n - 1 - F.col("id")).alias("old"), F.col("id").alias("new"))
    return _wide(mx.inverse_shuffle(a, maps, 0), WIDTH)


@query("WITH n AS (SELECT " + ", ".join(f"sqrt(sum(embedding[{p + 1}]::DOUBLE ** 2)) AS l{p}" for p in range(WIDTH)) + " FROM embeddings) SELECT vec_id AS row, " + ", ".join(f"round(embedding[{p + 1}]::DOUBLE / l{p}, 5) AS m{p}" for p in range(WIDTH)) + " FROM embeddings, n")
def normalize_norm2(spark, d):
    wide = _wide(mx.norm2(_emb(spark, d), WIDTH)[0], WIDTH)
    return wide.select("row", *(F.round(f"m{p}", 5).alias(f"m{p}") for p in range(WIDTH)))


@query(f"WITH {_X}, {_DIM} SELECT abs(" + " + ".join(f"{(p + 1) * (q + 1)} * {_gram_sql('(SELECT d0 FROM d)', p, q)} * {_gram_sql('(SELECT d1 FROM d)', p, q)} * {_gram_sql('(SELECT d2 FROM d)', p, q)}" for p in range(2) for q in range(2)) + ")::DOUBLE AS norm_sq")
def kruskal_norm_sq(spark, d):
    x = x_of(spark, d)
    return spark.createDataFrame([(model_norm_squared([1.0, 2.0], [mx.gram(u, 2) for u in _us(spark, x, 2)]),)], "norm_sq double")


@query("SELECT user_id::BIGINT AS i0, (day(ts) - 1)::BIGINT AS i1, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::DOUBLE AS v FROM events GROUP BY ALL")
def streaming_accumulate(spark, d):
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = accumulate(stream, [F.col("user_id"), F.dayofmonth("ts") - 1], F.when(F.col("value") > 0, 1).otherwise(0), f"{path}/sums")
    q.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/sums").groupBy("i0", "i1").agg(F.sum("v").alias("v"))


_MINUTE_SQL = "((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts))::BIGINT"
_MINUTES = f"m AS (SELECT user_id::BIGINT AS i0, {_MINUTE_SQL} AS i1, count(*)::DOUBLE AS v FROM events GROUP BY ALL)"
_BOXES = (
    "boxes AS (SELECT o_orderkey AS box, o_custkey % 150 AS u0, o_custkey % 150 + o_orderkey % 9 - 1 AS u1, "
    "o_orderkey * 37 % 43200 AS t0, o_orderkey * 37 % 43200 + o_custkey % 700 AS t1 FROM orders)"
)


def m_of(spark, d) -> SparseTensor:
    """Events by user and minute of the month."""
    minute = (F.dayofmonth("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    return SparseTensor.from_dataframe(_table(spark, d, "events"), [F.col("user_id"), minute], F.lit(1), how="count")


@query(f"WITH {_MINUTES}, {_BOXES} SELECT box, count(*) AS entries, sum(v)::DOUBLE AS v FROM m JOIN boxes ON i0 BETWEEN u0 AND u1 AND i1 BETWEEN t0 AND t1 GROUP BY box")
def range_join(spark, d):
    """Entries in boxes of users and minutes, some of them empty, summed by box."""
    user, minute = F.col("o_custkey") % 150, F.col("o_orderkey") * 37 % 43200
    boxes = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("box"), user.alias("u0"), (user + F.col("o_orderkey") % 9 - 1).alias("u1"), minute.alias("t0"), (minute + F.col("o_custkey") % 700).alias("t1"))
    return rg.within(m_of(spark, d).df, boxes, [("i0", "u0", "u1"), ("i1", "t0", "t1")]).groupBy("box").agg(F.count("*").alias("entries"), F.sum("v").alias("v"))


_OPEN_SQL = "datediff('day', TIMESTAMP '1992-01-01', {0})"


@query(
    f"WITH o AS (SELECT o_orderkey AS a, o_custkey AS c, {_OPEN_SQL.format('o_orderdate')} AS f, {_OPEN_SQL.format('o_orderdate')} + o_orderkey % 200 AS t FROM orders), "
    f"l AS (SELECT l_orderkey AS b, {_OPEN_SQL.format('l_shipdate')} AS g, {_OPEN_SQL.format('l_shipdate')} + l_linenumber AS u, o_custkey AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey) "
    "SELECT a AS order_key, count(*) AS lines FROM o JOIN l ON c = e AND f <= u AND g <= t GROUP BY a"
)
def interval_join(spark, d):
    """For each order the lines of its customer, of any order, under way while it is open."""
    day = lambda c: F.datediff(c, F.lit("1992-01-01"))
    orders = _table(spark, d, "orders")
    o = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("c"), day("o_orderdate").alias("f"), (day("o_orderdate") + F.col("o_orderkey") % 200).alias("t"))
    l = _table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.select(F.col("o_custkey").alias("e"), day("l_shipdate").alias("g"), (day("l_shipdate") + F.col("l_linenumber")).alias("u"))
    return rg.overlaps(o, l, ("f", "t"), ("g", "u"), [("c", "e")]).groupBy("order_key").agg(F.count("*").alias("lines"))


@query(
    "WITH r AS (SELECT user_id, ts, max(event_id) AS shown FROM events WHERE event_type = 'view' GROUP BY user_id, ts) "
    "SELECT e.event_id, r.shown FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE e.event_type <> 'view'"
)
def as_of_join(spark, d):
    """For each other event the user's last view."""
    rows = _table(spark, d, "events")
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("shown"))
    others = rows.where("event_type <> 'view'").select("event_id", "user_id", "ts")
    return rg.as_of(others, views, ["user_id"], "ts", ["shown"]).select("event_id", "last.shown")


@query(f"WITH {_MINUTES} SELECT *, lag(i1) OVER w AS last_i1, lag(v) OVER w AS last_v FROM m WINDOW w AS (PARTITION BY i0 ORDER BY i1)")
def previous_entry(spark, d):
    return rg.previous(m_of(spark, d), 1).select("i0", "i1", "v", F.col("last.i1").alias("last_i1"), F.col("last.v").alias("last_v"))


@query(
    f"WITH {_MINUTES} SELECT *, sum(v) OVER w AS total, max(v) OVER w AS top, count(*) OVER w AS entries FROM m "
    "WINDOW w AS (PARTITION BY i0 ORDER BY i1 RANGE BETWEEN 1440 PRECEDING AND 60 FOLLOWING)"
)
def moving_windows(spark, d):
    """A day back and an hour ahead along the minutes."""
    return rg.moving(m_of(spark, d), 1, 1440, 60, {"total": F.sum("v"), "top": F.max("v"), "entries": F.count("*")})


def _events_stream(spark, d) -> DataFrame:
    return spark.readStream.schema(_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _state_path(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


_cents = lambda: F.round(F.col("value") * 100)
_at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "WITH w AS (SELECT user_id::BIGINT AS i0, round(value * 100) AS v, date_trunc('hour', ts) - to_hours(k::INT) AS s FROM events, range(6) r(k)) "
    f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, i0, sum(v)::DOUBLE AS v FROM w WHERE s + INTERVAL 6 HOUR <= {_PASSED} GROUP BY s, i0"
)
def streaming_sliding(spark, d):
    """Windows of six hours, one an hour, that the watermark has passed."""
    found = st.sliding_tensor(_events_stream(spark, d), [F.col("user_id")], _cents(), "ts", "6 hours", "1 hour", "1 hour")
    return st.settle(found, _state_path(spark)).select(_at("start").alias("start"), "i0", "v")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) "
    "SELECT user_id::BIGINT AS i0, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS entries, sum(round(value * 100))::DOUBLE AS v "
    f"FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 2 HOUR <= {_PASSED}"
)
def streaming_sessions(spark, d):
    """A user's events that follow one another within two hours, of sessions that the watermark has passed."""
    found = st.session_tensor(_events_stream(spark, d), [F.col("user_id")], _cents(), "ts", "2 hours", "1 hour")
    return st.settle(found, _state_path(spark)).select("i0", _at("start").alias("start"), _at("end").alias("end"), "entries", "v")


@query("SELECT user_id::BIGINT AS i0, (day(ts) - 1)::BIGINT AS i1, sum(round(value * 100))::DOUBLE AS v FROM events GROUP BY ALL")
def streaming_repeats(spark, d):
    """Every event arrives twice and counts once."""
    twice = _events_stream(spark, d).unionByName(_events_stream(spark, d))
    once = st.settle(st.without_repeats(twice, ["event_id"], "ts", "1 hour"), _state_path(spark))
    return SparseTensor.from_dataframe(once, [F.col("user_id"), F.dayofmonth("ts") - 1], _cents()).df


@query(
    "SELECT user_id::BIGINT AS i0, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS time, arg_max(round(value * 100), struct_pack(t := ts, w := value))::DOUBLE AS v, count(*) AS entries "
    "FROM events GROUP BY user_id"
)
def streaming_newest(spark, d):
    """Each user's newest value."""
    with st.state_store(spark):
        found = st.settle(st.newest(_events_stream(spark, d), [F.col("user_id")], _cents(), "ts"), _state_path(spark), "update")
    return st.present(found).select("i0", _at("time").alias("time"), "v", "entries")


@query(
    "SELECT a.event_id AS first, b.event_id AS second FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR "
    "WHERE a.event_type = 'view' AND b.event_type = 'purchase'"
)
def streaming_join(spark, d):
    """Views and the purchases within three hours, as two streams."""
    a = _events_stream(spark, d).where("event_type = 'view'").select("user_id", F.col("event_id").alias("first"), F.col("ts").alias("viewed"))
    b = _events_stream(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("second"), F.col("ts").alias("bought"))
    found = st.joined(a, b, ["user_id"], "viewed", "bought", "3 hours", "1 hour")
    return st.settle(found, _state_path(spark)).select("first", "second")


@query(f"WITH {_S} SELECT * FROM s WHERE i0 BETWEEN 10 AND 40 AND i1 BETWEEN 100 AND 499 AND i2 <= 2")
def zorder_box(spark, d):
    """A box of suppliers, parts and lines out of the whole tensor, written in Z-order."""
    s, path = s_of(spark, d), f"{shared_dir(spark)}/zorder-{uuid.uuid4().hex}"
    zorder.write_zordered(s, path)
    return zorder.read_box(spark, path, s.ndims, (10, 100, 0), (41, 500, 3)).df
