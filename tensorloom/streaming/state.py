"""Streams with state: sliding windows, sessions, repeats left out, the newest value of a coordinate, two streams joined.

State is partitioned by coordinate and lives in Spark's state store, so a query that is started again with its
checkpoint goes on where it was. What a watermark has passed is dropped from the state; rows later than it are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tensorloom.tensor import mode_names

#: The state store that values with a life of their own need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _entries(stream: DataFrame, modes: Sequence[Column], value: Column, time: str, late: str) -> DataFrame:
    """(time, i0.., v) with a watermark; rows with a null among them are left out."""
    names = mode_names(len(modes))
    cols = [F.col(time).cast("timestamp").alias("time"), *(m.cast("bigint").alias(n) for m, n in zip(modes, names)), value.cast("double").alias("v")]
    return stream.select(*cols).dropna().withWatermark("time", late)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks ask for timestamps with a time zone: those without are taken to be of the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sliding_tensor(stream: DataFrame, modes: Sequence[Column], value: Column, time: str, window: str, slide: str, late: str) -> DataFrame:
    """(start, i0.., v): sums over each window of event time, one starting every ``slide``; given out when the watermark passes its end."""
    names = mode_names(len(modes))
    rows = _entries(stream, modes, value, time, late)
    return rows.groupBy(F.window("time", window, slide), *names).agg(F.sum("v").alias("v")).select(F.col("window.start").alias("start"), *names, "v")


def session_tensor(stream: DataFrame, modes: Sequence[Column], value: Column, time: str, gap: str, late: str) -> DataFrame:
    """(start, end, i0.., entries, v): a coordinate's entries that follow one another within ``gap``, counted and summed.

    ``end`` is the last entry's time and the gap; a session is given out when the watermark passes it.
    """
    names = mode_names(len(modes))
    rows = _entries(stream, modes, value, time, late)
    found = rows.groupBy(F.session_window("time", gap).alias("session"), *names).agg(F.count("*").alias("entries"), F.sum("v").alias("v"))
    return found.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *names, "entries", "v")


def without_repeats(stream: DataFrame, key: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key: repeats that come while the watermark hasn't passed the first one's time are left out."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(list(key))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of rows with equal keys, the right one up to ``within`` after the left one. All columns, the keys once.

    Both sides wait in the state until the watermarks say that no partner can come. Nulls meet nothing.
    """
    a, b = _timed(left, left_time, late), _timed(right, right_time, late)
    b = b.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    on = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on).drop(*(f"_{k}" for k in keys))


def settle(found: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream until its source has nothing more and reads what it gave out: ``path``/rows, a folder a batch,
    and the checkpoint beside it. A batch that is run again overwrites its own folder.
    """
    spark = found.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = found.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").select(*found.columns)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within it keep their state in ``STATE_STORE``."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Newest(StatefulProcessor):
    """A coordinate's newest entry, and how many have come: of two at one time, that of the greater value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("v", T.DoubleType()), T.StructField("entries", T.LongType())])
        self.newest = handle.getValueState("newest", state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best, entries = ((held[0], held[1]), held[2]) if held else (None, 0)
        for batch in rows:
            entries += len(batch)
            top = batch.sort_values(["time", "v"]).iloc[-1]
            here = (top["time"].to_pydatetime(), float(top["v"]))
            best = here if best is None or here > best else best
        self.newest.update((best[0], best[1], entries))
        yield pd.DataFrame({**{f"i{k}": [i] for k, i in enumerate(key)}, "time": [best[0]], "v": [best[1]], "entries": [entries]})

    def close(self) -> None:
        pass


def newest(stream: DataFrame, modes: Sequence[Column], value: Column, time: str) -> DataFrame:
    """(i0.., time, v, entries): after each batch the newest entry of every coordinate that it touched, late ones included,
    as updates: of a coordinate's rows that with the most entries is its present one (``present``).

    A coordinate's state is one row, kept for good: an entry may come however late. To be started within ``state_store``.
    """
    names = mode_names(len(modes))
    rows = stream.select(F.col(time).cast("timestamp").alias("time"), *(m.cast("bigint").alias(n) for m, n in zip(modes, names)), value.cast("double").alias("v")).dropna()
    out = T.StructType([*(T.StructField(n, T.LongType()) for n in names), T.StructField("time", T.TimestampType()), T.StructField("v", T.DoubleType()), T.StructField("entries", T.LongType())])
    return rows.groupBy(*names).transformWithStateInPandas(_Newest(), out, "Update", "None")


def present(updates: DataFrame) -> DataFrame:
    """Of what ``newest`` gave out over all batches the present row of each coordinate."""
    names = [c for c in updates.columns if c not in ("time", "v", "entries")]
    return updates.groupBy(*names).agg(F.max_by(F.struct("time", "v", "entries"), "entries").alias("r")).select(*names, "r.*")
