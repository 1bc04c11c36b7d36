"""Shards by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.common import materialize, running, shared_path, table, text_of

#: Bytes that a bucket, shuffled in memory by one task, holds on average.
BUCKET_BYTES = 8 << 20
ROW_BYTES = 16
#: Tasks of the second pass at most; with more buckets than that a task shuffles several, one after another.
MOST_TASKS = 100_000
#: Buckets, or hot keys, up to which their offsets are broadcast (about 40 bytes each); beyond, they are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def shard_of(key: Column, n: int, seed: int = 0) -> Column:
    """0 .. n-1: the shard whose hash with ``key`` is largest. With a further shard keys move only into it."""
    return F.greatest(*(F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(n)))["s"]


def size_of(text_col: str = "text") -> Column:
    return (F.octet_length(text_of(text_col)) + ROW_BYTES).cast("bigint")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns: rows that are equal in it are taken as equal."""
    plain = lambda f: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, docs.schema.fields))


def _numbered(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of the keys ``hot`` (k, h, fit), with part: their number among the key's rows, in the order of their hashes, divided by fit."""
    rows = materialize(keyed.drop("part").join(hot, ["k", "h"]).select("*", F.monotonically_increasing_id().alias("nth"), F.lit(1).alias("one")), "hot")
    ranked = running(rows, [F.col("k"), F.col("o"), F.col("nth")], "one", "rank", "k")
    return ranked.withColumn("part", F.floor(F.col("rank") / F.col("fit")))


def scattered(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass 1 of ``shuffled_shards``: (row, shard, bucket, index, h, o), and the number of buckets in all shards.

    bucket numbers the buckets of a shard, index those of all shards; equal rows, null ids and texts as there.
    """
    docs = docs.drop("shard", "slot")
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col)
    keyed = docs.select(F.struct("*").alias("row"), shard_of(key, n, seed).alias("shard"), F.xxhash64(key, text, F.lit(seed + 1)).alias("k"), F.xxhash64(key, text, F.lit(seed + 2)).alias("h"), _row_hash(docs).alias("o"), size_of(text_col).alias("size"))
    keys = materialize(keyed.groupBy("shard", "k", "h").agg(F.sum("size").alias("bytes"), F.max("size").alias("size")), "keys")
    per_shard = keys.groupBy("shard").agg(F.ceil(F.sum("bytes") / bucket_bytes).alias("buckets"))
    counts = {r["shard"]: r["buckets"] for r in per_shard.collect()}  # n rows
    buckets, starts = 0, []
    for shard, own in sorted(counts.items()):
        starts.append((shard, own, buckets))
        buckets += own
    per_shard = docs.sparkSession.createDataFrame(starts, "shard int, buckets bigint, first bigint")
    hot = keys.where((F.col("bytes") > bucket_bytes) & (F.col("bytes") > F.col("size"))).select("k", "h", F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes) / F.col("size"))).alias("fit"))
    keyed = keyed.drop("size").withColumn("part", F.lit(0).cast("bigint"))
    if many := hot.count():
        hot = F.broadcast(hot) if many <= BROADCAST_BUCKETS else hot
        keyed = keyed.join(hot.select("k", "h"), ["k", "h"], "left_anti").select(keyed.columns).union(_numbered(keyed, hot).select(keyed.columns))
    placed_in = F.pmod(F.xxhash64("k", "part"), F.col("buckets"))
    placed = keyed.join(F.broadcast(per_shard), "shard").select("row", "shard", "first", placed_in.alias("bucket"), "h", "o")
    return placed.select("row", "shard", "bucket", (F.col("first") + F.col("bucket")).alias("index"), "h", "o"), buckets


def shuffled_shards(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` plus shard (int) and slot (bigint), the row's place in its shard, from 0 without gaps.

    Pass 1 scatters the rows into the shards, by seeded hashes of the id, and within a shard into buckets of
    about ``bucket_bytes``, as many as the shard's bytes ask for, by seeded hashes of id and text; pass 2
    orders each bucket by hashes, last of all columns, so that reruns agree, shuffles it in memory (Fisher-Yates, ``shuffle``) and
    numbers it after the buckets before it. Which task shuffles a bucket, and so its order, follows from the
    bucket's number alone, not from the cluster's settings. All orders of a shard are as likely. Columns named shard or slot
    are replaced; null texts count as empty, null ids as one id; rows that repeat an id share its shard.
    Those that repeat its text too share a bucket up to ``bucket_bytes`` and are scattered in parts of that
    size beyond; an empty table gives no rows.
    """
    keyed, buckets = scattered(docs, n, id_col, text_col, seed, bucket_bytes)
    counts = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    offsets = F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets
    tasks = max(1, min(buckets, MOST_TASKS))
    dealt = keyed.withColumn("task", F.pmod("index", F.lit(tasks)).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("task", "index", "h", "o")
    filled = dealt.groupBy("task", "index", "shard", "bucket").agg(F.collect_list("row").alias("rows"))
    placed = filled.select("shard", "bucket", F.shuffle("rows", F.lit(seed)).alias("rows")).join(offsets, ["shard", "bucket"])
    return placed.select("shard", "offset", F.posexplode_outer("rows").alias("place", "row")).select("row.*", "shard", (F.col("offset") + F.col("place")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard; its files hold whole buckets, in the order of their slots. An empty table gives an empty folder."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def stored(sharded: DataFrame) -> DataFrame:
    """``sharded`` as its folders in the shared folder give it back."""
    path = shared_path(sharded.sparkSession, "shards")
    write_shards(sharded, path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(sharded.columns)


def op8_shards(spark, sf_dir: str, n: int = 40) -> DataFrame:
    """The documents' places in the written shards, as the contract of this query asks."""
    placed = stored(shuffled_shards(table(spark, sf_dir, "documents"), n))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = text_of()
    return placed.select(
        "doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        shard_of(key, n + 1).alias("grown_shard"),
    )
