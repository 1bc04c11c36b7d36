"""The corpus pipeline: quality, near-duplicates, benchmark passages, source weights, shards.

In every stage a null text counts as an empty one, an empty table gives an empty table, all columns come back whatever
their names, and rows are judged one by one, however often they repeat, unless the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import mixing, quality, shards, simhash, winnow
from tensorloom.llm.common import label_fold, materialize, table

N_SHARDS = 40


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject.

    Rows that repeat a text fare alike; those with a null id are judged, but not learnt from; a score of 0.5 stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), label_fold(F.col("id"), 3) != 1)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five-word Jaccard likeness 0.8 or more, the document with the smallest id.

    A null id is larger than all others; of rows equal in id and text one stays; texts without words are one group.
    """
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Items without words have none; neither have documents without words, which stay."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them: none to three times.

    Documents without words go. A null source is a source, the last; of equal finish times the packet served first comes first,
    then the smaller source.
    """
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot, written a folder a shard. Columns of these names are replaced; null ids are one id."""
    return shards.stored(shards.shuffled_shards(docs, N_SHARDS))


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]
#: SQL can express neither the classifier nor the hashes; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written and read again but for the last, which writes by itself."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
