"""Connected components of an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); label is the smallest node reachable.

    Every round joins each edge with the least neighbour of its end, never gathering a neighbourhood in one
    row, so a node with any number of links is only a skewed join key. Rounds grow with the logarithm of the
    longest path; each is written to the shared folder. Rows with a null or equal ends are ignored; an empty
    table gives an empty result.
    """
    edges = materialize(edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")), "edges")
    seal = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = None
    while True:
        now = edges.agg(seal.alias("s")).first()[0]
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = now
        edges = materialize(_small_star(_large_star(edges)), "edges")
