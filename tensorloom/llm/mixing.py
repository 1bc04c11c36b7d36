"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import WORD, materialize, running, scratch, table, text_of

#: Times that the mix may take a document.
MOST = 3
#: Sources up to which their targets are broadcast (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, level) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words by weight; a target stops at
    MOST times the source's size and the excess is shared again: every source is served at its weight until
    the virtual time ``level``, when the whole budget is spent, or until it is used up.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row a source
    weighed = sizes.select("source", "source_size", ((rank - 1) % 3 + 1).cast("double").alias("weight"), (MOST * F.col("source_size")).cast("double").alias("most"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # The level if exactly the sources that are used up earlier than this one were used up.
    spent, gone = F.coalesce(F.sum("most").over(first), F.lit(0.0)), F.coalesce(F.sum("weight").over(first), F.lit(0.0))
    tried = weighed.withColumn("if", (F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - gone))
    level = F.min(F.when(F.col("if") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "if"))).over(every)["if"]
    return tried.withColumn("level", level).select("source", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("most")).alias("target"), "level")


def words_of_copy(c: int) -> Column:
    """Words of copy ``c`` of a scheduled document that are served before the virtual time ``level``."""
    left = F.floor("target") - F.col("start") - c * F.col("source_size")
    return F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), left))


def finish_of_copy(c: int) -> Column:
    """The virtual time at which copy ``c`` ends: the words of its source up to its end, by the source's weight."""
    return (c * F.col("source_size") + F.col("start") + F.col("size")) / F.col("weight")


def queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(row, id, source, size, source_size, target, level, weight, start): a row for each of ``docs``.

    row numbers the rows of ``docs`` as read; start counts the words of the source queued before it.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    sized = materialize(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.col(source_col).alias("source"), words.alias("size"), order.alias("order")), "sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    started = running(sized, [F.col(c) for c in ("source", "order", "id", "size", "text_hash", "row")], "size", "start", "source")
    met = started.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")))
    return met.select("row", "id", "source", "size", "source_size", "target", "level", "weight", "start")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(row, id, source, size, source_size, target, taken, finish): a row for each of ``docs``.

    A source's documents are queued in a seeded shuffled order, over and over, at most MOST times; copy c of a
    document ends at virtual time (c * source_size + start + size) / weight, where start counts the words queued
    before it. All copies are sorted by that time and cut off where the words reach the budget, the size of all
    documents. A copy in service at the virtual time ``level`` goes in two packets: the words served until then,
    which end then, and the rest, which ends with the copy; so each source's words are its target, but for
    fewer than one word a source. Ties go to the packet served first, then to the smaller source, then to the
    earlier row. taken: words of the row; finish: when its wholly taken copies end, ascending.

    A null text has size 0; a null source is a source of its own, the last; rows with equal id, text and source
    are queued one after another; an empty table gives no rows; other columns aren't read. Reruns agree.
    """
    plan = materialize(queued(docs, id_col, text_col, source_col, seed), "queued")
    packets = []
    for c in range(MOST):
        served, finish = words_of_copy(c), finish_of_copy(c)
        packets.append(F.struct(F.lit(c).alias("copy"), F.lit(0).alias("late"), served.alias("words"), F.least(finish, F.col("level")).alias("finish")))
        packets.append(F.struct(F.lit(c).alias("copy"), F.lit(1).alias("late"), (F.col("size") - served).alias("words"), F.greatest(finish, F.col("level")).alias("finish")))
    stream = plan.select("row", "source", F.explode(F.array(*packets)).alias("p")).select("row", "source", "p.*").where("words > 0")
    budget = plan.agg(F.sum("size").alias("budget"))  # one row
    sent = running(stream, [F.col("finish"), F.col("late"), F.col("source").asc_nulls_last(), F.col("row"), F.col("copy")], "words", "ahead").crossJoin(F.broadcast(budget))
    cut = F.least(F.col("words"), F.greatest(F.lit(0).cast("bigint"), F.col("budget") - F.col("ahead")))
    taken = sent.select("row", "copy", cut.alias("cut")).groupBy("row").agg(F.sum("cut").alias("taken"), *(F.sum(F.when(F.col("copy") == c, F.col("cut"))).alias(f"t{c}") for c in range(MOST)))
    whole = F.filter(F.array(*(F.when(F.col(f"t{c}") == F.col("size"), finish_of_copy(c)) for c in range(MOST))), F.isnotnull)
    return plan.join(taken, "row", "left").select("row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), whole.alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mixed rows of ``docs``, globally sorted by virtual finish time (then by row): whole documents, at most MOST times.

    Documents that the end of the budget would cut are left out, and so are those without words; nulls, ties,
    repeated rows and empty tables as in ``schedule``. All columns come back, whatever their names. The rows are
    numbered and written once, so that each meets its own copies.
    """
    rows = materialize(docs.select(F.struct("*").alias("row")).withColumn("_row", F.monotonically_increasing_id()), "rows", keep=True)
    row = F.col("row")
    read = rows.select("_row", row[id_col].alias("id"), row[text_col].alias("text"), row[source_col].alias("source"))
    with scratch(docs.sparkSession):
        plan = schedule(read, "id", "text", "source", seed).where(F.size("finish") > 0)
        plan = materialize(plan.select(F.col("row").alias("_of"), F.explode("finish").alias("finish")), "finish", keep=True)
    out = rows.select("row", "_row").join(plan, F.col("_row") == F.col("_of"))
    return out.repartitionByRange("finish", "_row").sortWithinPartitions("finish", "_row").select("row.*")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    plan = schedule(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('0:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM g),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER k, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER k, 0)) AS lv FROM w
      WINDOW k AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lv, most / weight) AS level FROM f WHERE lv <= most / weight),
t AS (SELECT source, source_size, least(weight * level, most) AS target, level, weight FROM w, l),
q AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.level, t.weight, floor(t.target)::BIGINT AS whole,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, k * source_size + start AS ahead, least(size, greatest(0, whole - start - k * source_size)) AS served,
        (k * source_size + start + size)::DOUBLE / weight AS finish FROM q, range(3) r(k)),
p AS (SELECT doc_id, source, 0 AS late, served AS words, least(finish, level) AS ends FROM c
      UNION ALL SELECT doc_id, source, 1, size - served, greatest(finish, level) FROM c),
x AS (SELECT doc_id, least(words, greatest(0, (SELECT sum(size) FROM s) - coalesce(sum(words) OVER (ORDER BY ends, late, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM p WHERE words > 0),
y AS (SELECT doc_id, sum(taken)::BIGINT AS taken FROM x GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(y.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN y USING (doc_id)
"""
