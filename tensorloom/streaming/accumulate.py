"""Entries that arrive as a stream: windowed sums, and a tensor kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tensorloom.tensor import mode_names


def windowed_tensor(stream: DataFrame, modes: Sequence[Column], value: Column, time: str, window: str, late: str) -> DataFrame:
    """(start, i0.., v): a tensor for each tumbling window of event time; rows later than ``late`` are dropped."""
    names = mode_names(len(modes))
    rows = stream.withWatermark(time, late).select(F.col(time), *(m.cast("bigint").alias(n) for m, n in zip(modes, names)), value.cast("double").alias("v"))
    return rows.groupBy(F.window(time, window), *names).agg(F.sum("v").alias("v")).select(F.col("window.start").alias("start"), *names, "v")


def accumulate(stream: DataFrame, modes: Sequence[Column], value: Column, path: str) -> DataStreamWriter:
    """Appends each batch's sums to the table ``path`` under its number: addition is associative, so the tensor is
    the sum over the table, and a batch that is run again overwrites its own part."""
    names = mode_names(len(modes))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(*(m.cast("bigint").alias(n) for m, n in zip(modes, names)), value.cast("double").alias("v"))
        rows.groupBy(*names).agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put)
