"""Places and running sums in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.storage import materialize
from tensorloom.tensor import tasks_of


def _running(df: DataFrame, sums: Mapping[str, str], runs: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` plus, for each of ``sums``, _w_ with the sum of its column over the rows before in the task, and for each of
    ``runs`` the number of runs of equal values of its columns that ended before in the task. Batch by batch: nothing is held."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, last = dict.fromkeys(sums, 0), {}
        for batch in them:
            if not len(batch):
                continue
            numbers = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            out = []
            for o, c in sums.items():
                upto = so_far[o] + np.cumsum(numbers(c))
                out.append(np.append(so_far[o], upto[:-1]))
                so_far[o] = int(upto[-1])
            for o, columns in runs.items():
                values = np.column_stack([numbers(c) for c in columns])
                before, at = last.get(o, (values[0], 0))
                out.append(at + np.cumsum((values != np.vstack([before, values[:-1]])).any(1)))
                last[o] = (values[-1], int(out[-1][-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in out)], names=names)

    names = [*df.columns, *(f"_w_{o}" for o in (*sums, *runs))]
    schema = T.StructType([*df.schema, *(T.StructField(n, T.LongType()) for n in names[len(df.columns) :])])
    return df.mapInArrow(batches, schema)


def with_pos(df: DataFrame, keys: Sequence[Column | str], sums: Mapping[str, str] | None = None, runs: Mapping[str, Sequence[str]] | None = None, rows: int | None = None) -> DataFrame:
    """``df`` plus pos, its place, from 0, in the order of ``keys``, for each of ``sums`` (new column: column of whole numbers)
    the sum of the column over the rows before, and for each of ``runs`` (new column: columns of whole numbers) the number,
    from 0, of the row's combination of these columns, which ``keys`` begin with.

    Rows are range-partitioned, counted and summed by partition; of no more than ``rows`` rows, if they are known, so many
    partitions that one doesn't grow with them. The sorted rows are written once, so that the partitions counted are
    those numbered. A combination of ``runs`` is in one partition.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    sums, runs = dict(sums or {}), dict(runs or {})
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_of(rows or 0))
    split = [F.col(c) for c in min(runs.values(), key=len)] if runs else cols
    ranked = df.repartitionByRange(parts, *split).sortWithinPartitions(*cols)
    if sums or runs:
        ranked = _running(ranked, sums, runs)
    ranked = materialize(ranked.withColumn("_m", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = ranked.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{o}") for o, c in sums.items()), *((F.max(f"_w_{o}") + 1).alias(f"_t_{o}") for o in runs))
    offsets = totals.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), *(F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in (*sums, *runs)))
    out = ranked.join(F.broadcast(offsets), "_p").withColumn("pos", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    for o in (*sums, *runs):
        out = out.withColumn(o, (F.col(f"_o_{o}") + F.col(f"_w_{o}")).cast("bigint"))
    return out.drop("_m", "_p", "_o", *(f"_{t}_{o}" for t in "ow" for o in (*sums, *runs)))
