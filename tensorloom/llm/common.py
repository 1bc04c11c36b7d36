"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.storage import materialize, scratch, shared_dir, shared_path

__all__ = ["label_fold", "lower_ascii", "materialize", "running", "scratch", "shared_dir", "shared_path", "table", "text_of"]

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def label_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the doc_id as text, modulo ``mod``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def running(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over the rows before each in ``order`` (of those with an equal ``group``, nulls equal).

    ``order`` starts with the group and ends with something unique, so that range partitions split anything.
    Rows are summed within range partitions; across them only the partitions' totals, a row for each partition
    and group in it, are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_rank", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordered").withColumn("_part", F.shiftright("_rank", 33))
    by = [group] if group else []
    across = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset")
    totals = ranged.groupBy("_part", *by).agg(F.sum(value).alias("_n")).select(F.col("_part").alias("_p"), *(F.col(g).alias("_g") for g in by), offset)
    within = Window.partitionBy("_part", *by).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    met = F.col("_part") == F.col("_p")
    if group:
        met &= F.col(group).eqNullSafe(F.col("_g"))
    summed = ranged.withColumn("_ahead", F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, met)
    return summed.select(*df.columns, (F.col("_offset") + F.col("_ahead")).alias(out))
