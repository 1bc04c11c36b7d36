import pytest
from pyspark.sql import functions as F

from tensorloom.streaming import state as st
from tensorloom.streaming.accumulate import accumulate, windowed_tensor

SCHEMA = "user bigint, day bigint, n double, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    for k, rows in enumerate([[(0, 1, 2.0, "2024-01-01 00:00:10"), (0, 1, 3.0, "2024-01-01 00:00:50")], [(1, 0, 4.0, "2024-01-01 00:02:00"), (0, 1, 1.0, "2024-01-01 00:10:00")]]):
        spark.createDataFrame(rows, "user bigint, day bigint, n double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert k >= 0
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_accumulate(spark, stream, tmp_path):
    q = accumulate(stream, [F.col("user"), F.col("day")], F.col("n"), f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    total = spark.read.parquet(f"{tmp_path}/out").groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    assert sorted(map(tuple, total.collect())) == [(0, 1, 6.0), (1, 0, 4.0)]


def test_windows(spark, stream, tmp_path):
    sums = windowed_tensor(stream, [F.col("user"), F.col("day")], F.col("n"), "ts", "1 minute", "1 minute")
    q = sums.writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    found = {(str(r["start"])[-8:], r["i0"], r["v"]) for r in spark.table("sums").collect()}
    assert ("00:00:00", 0, 5.0) in found


def batches(spark, path, *groups):
    for rows in groups:
        spark.createDataFrame(rows, "user bigint, day bigint, n double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_newest_over_batches_and_a_restart(spark, tmp_path):
    first = [(0, 1, 2.0, "2024-01-01 00:00:10"), (0, 1, 3.0, "2024-01-01 00:00:50"), (1, 1, 5.0, "2024-01-01 00:00:00"), (None, 1, 5.0, "2024-01-01 00:00:00")]
    late = [(0, 1, 9.0, "2024-01-01 00:00:20"), (1, 1, 4.0, "2024-01-01 00:00:00"), (0, 1, None, "2025-01-01 00:00:00")]
    more = [(1, 1, 6.0, "2024-01-01 00:00:00"), (2, 2, 1.0, "2024-01-02 00:00:00"), (0, 1, 3.0, "2024-01-01 00:00:50")]
    run = lambda s: {(r.i0, r.i1): (r.v, r.entries) for r in st.present(st.settle(st.newest(s, [F.col("user"), F.col("day")], F.col("n"), "ts"), f"{tmp_path}/out", "update")).collect()}
    with st.state_store(spark):
        assert run(batches(spark, tmp_path, first, late)) == {(0, 1): (3.0, 3), (1, 1): (5.0, 2)}
        assert run(batches(spark, tmp_path, more)) == {(0, 1): (3.0, 4), (1, 1): (6.0, 3), (2, 2): (1.0, 1)}


def test_sessions_over_batches(spark, tmp_path):
    stream = batches(
        spark, tmp_path,
        [(0, 1, 2.0, "2024-01-01 00:00:00"), (0, 1, 3.0, "2024-01-01 00:08:00")],
        [(0, 1, 4.0, "2024-01-01 00:15:00"), (1, 1, 1.0, "2024-01-01 00:15:00")],
        [(0, 1, 7.0, "2024-01-01 02:00:00")],
        [(0, 1, 7.0, "2024-01-01 02:00:01")],  # rows count as late by the watermark of the batch before
        [(0, 1, 9.0, "2024-01-01 00:01:00")],
    )
    found = st.settle(st.session_tensor(stream, [F.col("user")], F.col("n"), "ts", "10 minutes", "30 minutes"), f"{tmp_path}/out")
    assert sorted((r.i0, r.entries, r.v) for r in found.collect()) == [(0, 3, 9.0), (1, 1, 1.0)]


def test_sliding_windows_overlap(spark, tmp_path):
    stream = batches(spark, tmp_path, [(0, 1, 2.0, "2024-01-01 00:07:00"), (0, 1, 3.0, "2024-01-01 00:12:00")], [(0, 1, 1.0, "2024-01-01 03:00:00")])
    found = st.settle(st.sliding_tensor(stream, [F.col("user")], F.col("n"), "ts", "10 minutes", "5 minutes", "1 minute"), f"{tmp_path}/out")
    assert sorted((str(r.start)[11:16], r.v) for r in found.collect()) == [("00:00", 2.0), ("00:05", 5.0), ("00:10", 3.0)]


def test_repeats_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [(0, 1, 2.0, "2024-01-01 00:00:00"), (0, 1, 5.0, "2024-01-01 00:00:01")], [(0, 1, 7.0, "2024-01-01 00:00:02"), (3, 1, 7.0, "2024-01-01 00:00:02")])
    found = st.settle(st.without_repeats(stream, ["user", "day"], "ts", "1 hour"), f"{tmp_path}/out")
    assert sorted(r.user for r in found.collect()) == [0, 3]


def test_streams_joined_over_batches(spark, tmp_path):
    left = batches(spark, tmp_path / "a", [(0, 1, 2.0, "2024-01-01 00:00:00")], [(0, 1, 3.0, "2024-01-01 00:05:00"), (None, 1, 3.0, "2024-01-01 00:05:00")])
    right = batches(spark, tmp_path / "b", [(0, 1, 8.0, "2024-01-01 00:09:00")], [(0, 1, 9.0, "2024-01-01 00:12:00"), (None, 1, 3.0, "2024-01-01 00:06:00")])
    right = right.select("user", F.col("n").alias("m"), F.col("ts").alias("then"))
    found = st.settle(st.joined(left.select("user", "n", "ts"), right, ["user"], "ts", "then", "10 minutes", "1 hour"), f"{tmp_path}/out")
    assert sorted((r.user, r.n, r.m) for r in found.collect()) == [(0, 2.0, 8.0), (0, 3.0, 8.0), (0, 3.0, 9.0)]
