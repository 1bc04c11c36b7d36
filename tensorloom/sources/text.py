"""Tensors, matrices and maps as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError
from tensorloom.operators.hicoo import HiCOO, block_pointers, chunk_pointers, kernel_pointers, schedule
from tensorloom.operators.positions import with_pos
from tensorloom.tensor import SparseTensor, mode_names


def _header(lines: DataFrame, files: Sequence[str]) -> tuple[list, str]:
    """The first two of ``lines`` (line, file, at) in the first file by name, and that file.

    The condition on the file reaches the listing, so that only it is read, from its first split on: ``at`` counts its
    lines in order, and does so again wherever the same condition holds.
    """
    first = (files[0] if files else "").replace("file:///", "file:/", 1)  # as the metadata column writes it
    return lines.where(F.col("file") == first).limit(2).collect(), first


def read_tns(spark: SparkSession, path: str, start_index: int = 1, ndims: Sequence[int] | None = None, strict: bool = True) -> SparseTensor:
    """A tensor from lines: the number of modes, the sizes, then indices and value of an entry each.

    ``ndims`` for files without the first two lines. Indices count from ``start_index``. strict: a malformed
    line raises when it is read; else it is left out. Explicit zeros are dropped, equal coordinates stay.
    """
    line = F.trim("value", F.lit(" \t\n\x0b\f\r")).alias("line")
    lines = spark.read.text(path).select(line, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    if ndims is None:
        head, first = _header(lines, sorted(spark.read.text(path).inputFiles()))
        try:
            (n,), ndims = map(int, head[0]["line"].split()), tuple(map(int, head[1]["line"].split()))
        except (ValueError, IndexError) as e:
            raise TensorValueError("the first two lines don't give the modes and their sizes") from e
        if n != len(ndims) or n < 1:
            raise TensorValueError(f"{len(ndims)} sizes for {n} modes")
        lines = lines.where(F.col("file") != first).unionByName(lines.where((F.col("file") == first) & (F.col("at") > head[1]["at"])))
    n = len(ndims)
    words = lines.select("line", F.split("line", r"\s+").alias("w"))
    at = lambda k, kind: F.get("w", F.lit(k)).try_cast(kind)
    parsed = words.select("line", (F.size("w") == n + 1).alias("_ok"), *((at(k, "bigint") - start_index).alias(m) for k, m in enumerate(mode_names(n))), at(n, "double").alias("v"))
    good = F.col("_ok") & F.col("v").isNotNull()
    for m in mode_names(n):
        good = good & F.col(m).isNotNull() & (F.col(m) >= 0)
    if strict:
        parsed = parsed.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("malformed entry: "), F.col("line"))).cast("double")))
    else:
        parsed = parsed.where(good)
    return SparseTensor(parsed.select(*mode_names(n), "v").where("v <> 0"), ndims)


def tns_lines(x: SparseTensor, start_index: int = 1) -> DataFrame:
    """(line) for every entry, its modes first: indices and value with six decimals, by tabs."""
    return x.df.select(*x.modes, F.concat_ws("\t", *((F.col(m) + start_index).cast("string") for m in x.modes), F.format_string("%.6f", "v")).alias("line"))


def write_tns(x: SparseTensor, path: str, start_index: int = 1) -> None:
    """Sorted lines in part files of the folder ``path``, the header in the first."""
    spark = x.df.sparkSession
    head = spark.createDataFrame([(0, str(x.nmodes)), (1, " ".join(map(str, x.ndims)))], "_h int, line string")
    body = tns_lines(x, start_index).withColumn("_h", F.lit(2))
    for m in x.modes:
        head = head.withColumn(m, F.lit(-1).cast("bigint"))
    head.unionByName(body).orderBy("_h", *x.modes).select("line").write.text(path)


def numbered_words(spark: SparkSession, path: str) -> DataFrame:
    """(at, w): the words of a text, numbered from 0 through all its files (by path) and lines.

    Files are split as usual and lines numbered by split and place in it; a line is a row.
    """
    lines = spark.read.text(path).select(
        F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    starts = with_pos(lines.withColumn("n", F.size("w").cast("bigint")), ["file", "block", "line"], {"first": "n"})
    return starts.select("first", F.posexplode("w").alias("k", "w")).select((F.col("first") + F.col("k")).alias("at"), "w")


def read_maps(spark: SparkSession, path: str, ndims: Sequence[int]) -> DataFrame:
    """(mode, old, new) from 1-based new indices, a mode after the other, however lines break."""
    start, mode, old = 0, F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k, d in enumerate(ndims):
        inside = (F.col("at") >= start) & (F.col("at") < start + d)
        mode, old = F.when(inside, F.lit(k)).otherwise(mode), F.when(inside, F.col("at") - start).otherwise(old)
        start += d
    return numbered_words(spark, path).select(mode.alias("mode"), old.alias("old"), (F.col("w").cast("bigint") - 1).alias("new")).where("mode is not null")


def read_matrix_transposed(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(row, vals), rows, columns of the transpose of a matrix: ``2 ncols nrows``, then the values by rows."""
    words = numbered_words(spark, path)
    head = {r["at"]: r["w"] for r in words.where("at < 3").collect()}
    try:
        two, ncols, nrows = (int(head[k]) for k in range(3))
    except (KeyError, ValueError) as e:
        raise TensorValueError("the first three words aren't 2 and the sizes") from e
    if two != 2:
        raise TensorValueError("a matrix has two modes")
    cells = words.where((F.col("at") >= 3) & (F.col("at") < 3 + nrows * ncols)).select((F.col("at") - 3).alias("at"), F.col("w").cast("double").alias("v"))
    cells = cells.select(F.pmod("at", F.lit(nrows)).cast("bigint").alias("row"), F.floor(F.col("at") / nrows).alias("col"), "v")
    rows = cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda c: c["v"]).alias("vals"))
    return rows, nrows, ncols


def matrix_lines(a: DataFrame) -> DataFrame:
    """(row, line): values with two decimals, by tabs."""
    return a.select("row", F.array_join(F.transform("vals", lambda x: F.format_string("%.2f", x)), "\t").alias("line"))


def write_matrix(a: DataFrame, path: str, nrows: int, ncols: int) -> None:
    head = a.sparkSession.createDataFrame([(-1, f"{nrows} x {ncols} matrix")], "row bigint, line string")
    head.unionByName(matrix_lines(a)).orderBy("row").select("line").write.text(path)


def hicoo_lines(h: HiCOO) -> DataFrame:
    """(part, at, line): the arrays of the blocked format, as text, part by part."""
    number = lambda df, part, keys, line: df.select(F.lit(part).alias("part"), F.struct(*keys).cast("string").alias("at"), line.alias("line"))
    text = lambda *cols: F.concat_ws(" ", *(F.col(c).cast("string") for c in cols))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    kernels = schedule(h).groupBy("mode", "k").agg(F.sort_array(F.collect_list("kid")).alias("kids"))  # a line holds them all
    parts = [
        number(kernels, "kschr", [F.col("mode"), pad("k")], F.concat_ws(" ", F.col("mode").cast("string"), F.col("k").cast("string"), F.array_join("kids", ","))),
        number(kernel_pointers(h), "kptr", [pad("kid")], text("kid", "kptr")),
        number(chunk_pointers(h), "cptr", [pad("kid"), pad("cid")], text("kid", "cid", "first_block")),
        number(block_pointers(h), "bptr", [pad("bid")], text("bid", "bptr", *h.blocks)),
    ]
    elems = h.df.select(*h.blocks, F.posexplode("elems").alias("_at", "e"))
    offsets = F.concat_ws(" ", *(F.col(f"e.e{k}").cast("string") for k in range(len(h.ndims))), F.format_string("%.6f", "e.v"))
    parts.append(number(elems, "elems", [*(pad(b) for b in h.blocks), pad("_at")], offsets))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def show_vector(pos_value: DataFrame, form: str = "%s") -> DataFrame:
    """(pos, line) of a vector (pos, v)."""
    value: Column = F.format_string(form, F.col("v"))
    return pos_value.select("pos", value.alias("line")).orderBy("pos")

