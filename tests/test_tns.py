"""Tensors as text: Spark's text source and ``format("tns")`` over the same files."""

import io
import os

import pytest
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError
from tensorloom.sources import text, tns
from tensorloom.tensor import SparseTensor


def seal(x):
    return tuple(x.df.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("i0", "i1", "v").cast("decimal(20,0)"))).first())


@pytest.fixture(scope="module")
def many(spark):
    """Three million entries whose first range is the smallest file."""
    n = 3_000_000
    rows = spark.range(n).select(F.expr("CAST(sqrt(id) AS BIGINT) * 1000").alias("i0"), "id", (F.col("id") % 97 + 1).cast("double").alias("v"))
    return SparseTensor(rows.withColumnRenamed("id", "i1"), (2_000_000, n))


def test_three_million_entries_come_back(spark, many, tmp_path):
    text.write_tns(many, f"{tmp_path}/t")
    parts = [os.path.getsize(f"{tmp_path}/t/{f}") for f in sorted(os.listdir(f"{tmp_path}/t")) if f.startswith("part")]
    assert len(parts) > 1 and parts[0] < max(parts)
    want = seal(many)
    got = text.read_tns(spark, f"{tmp_path}/t")
    assert got.ndims == many.ndims and seal(got) == want
    there = tns.load(spark, f"{tmp_path}/t", split_bytes=1_000_003)
    assert there.ndims == many.ndims and there.df.rdd.getNumPartitions() > 30 and seal(there) == want
    tns.save(many, f"file://{tmp_path}/s")
    assert seal(tns.load(spark, f"{tmp_path}/s")) == want and seal(text.read_tns(spark, f"{tmp_path}/s")) == want


def test_header_like_lines_stay(spark, tmp_path):
    """An entry may look like a header line, here the sizes of one mode; blank lines are none."""
    (tmp_path / "t.tns").write_text("\n1\n \n5 \n5 2\n1\t3.5\n\n2 0\n1 1\n")
    for x in (text.read_tns(spark, f"{tmp_path}/t.tns"), tns.load(spark, f"{tmp_path}/t.tns")):
        assert x.ndims == (5,) and x.entries() == [(0, 1.0), (0, 3.5), (4, 2.0)]
    (tmp_path / "u.tns").write_text("1\n5\n1\n5\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_tns(spark, f"{tmp_path}/u.tns").entries()
    with pytest.raises(Exception, match="malformed"):
        tns.load(spark, f"{tmp_path}/u.tns").entries()


def test_malformed(spark, tmp_path):
    (tmp_path / "bad.tns").write_text("2\n3 3\n1 1 1\n1 x 1\n0 1 1\n1 1\n2 2 2\n3 3 nan\n")
    got = tns.load(spark, f"{tmp_path}/bad.tns", strict=False).entries()
    assert got[:2] == [(0, 0, 1.0), (1, 1, 2.0)] and got[2][2] != got[2][2] and len(got) == 3
    with pytest.raises(Exception, match="malformed"):
        tns.load(spark, f"{tmp_path}/bad.tns").entries()
    (tmp_path / "low.tns").write_text("2\n3 3\n1 0 1\n")
    with pytest.raises(Exception, match="below"):
        tns.load(spark, f"{tmp_path}/low.tns").entries()
    for name, words in (("head", "1 2 3\n"), ("none", ""), ("wrong", "3\n2 2\n1 1 1 1\n")):
        (tmp_path / name).write_text(words)
        with pytest.raises(TensorValueError):
            tns.load(spark, f"{tmp_path}/{name}")
    assert tns.load(spark, f"{tmp_path}/bad.tns", ndims=(3, 3), strict=False).nnz == 3
    with pytest.raises(TensorValueError):
        tns.load(spark, f"{tmp_path}/absent")


@pytest.mark.parametrize("width", range(1, 12))
def test_every_line_is_in_one_split(width):
    data = b"ab\n\nc\nlonger line\n\nx"
    for piece in (1, 3, 100):
        parts = [b"".join(tns.pieces(io.BytesIO(data), at, min(at + width, len(data)), piece)) for at in range(0, len(data), width)]
        assert b"".join(p if p.endswith(b"\n") or not p else p + b"\n" for p in parts) == data + b"\n"


def test_append_overwrite_and_abort(spark, tmp_path):
    x = SparseTensor.from_rows(spark, [(0, 0, 1.0), (2, 1, -2.5)], (3, 2))
    path = f"{tmp_path}/t"
    tns.save(x, path)
    tns.save(x, path)
    assert tns.load(spark, path).entries() == sorted(x.entries() * 2)
    with pytest.raises(Exception, match="the sizes that are there"):
        tns.save(SparseTensor.from_rows(spark, [(0, 0, 1.0)], (9, 9)), path)
    broken = SparseTensor(x.df.withColumn("v", F.when(F.col("i0") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v"))), x.ndims)
    with pytest.raises(Exception, match="lost"):
        tns.save(broken, path, mode="overwrite")
    assert tns.load(spark, path).nnz == 4 and not [f for f in os.listdir(path) if f.startswith("_staging")]
    tns.save(x, path, mode="overwrite")
    assert tns.load(spark, path).entries() == x.entries()
    tns.save(SparseTensor.empty(spark, (4, 4)), f"{tmp_path}/e")
    assert tns.load(spark, f"{tmp_path}/e").ndims == (4, 4) and tns.load(spark, f"{tmp_path}/e").entries() == []
