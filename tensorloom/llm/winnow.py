"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import lower_ascii, materialize, table, text_of

#: What separates words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shared spans of SPAN words are found for certain: K + WINDOW - 1 = SPAN.
SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Benchmark fingerprints up to which they are broadcast (about 300 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _range(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hash_at(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(hashes, at + i) for i in range(n))).bitwiseAND(F.lit(-2).cast("bigint"))  # even: odd ones mark documents


def _row(pos: Column, code: Column, n: Column, before: Column, context: Column) -> Column:
    return F.struct(pos.alias("pos"), code.alias("code"), n.alias("n"), before.alias("before"), context.alias("context"))


def _short_row(n: int):
    return lambda p: _row(p, _hash_at(F.col("hw"), p, n), F.lit(n), F.lit(0), F.slice("w", p + 1, n))


def winnowed(df: DataFrame, short: list[int], whole: bool) -> DataFrame:
    """``df`` (with an array of words, ``w``) plus ``prints``: its fingerprints as structs.

    Of every WINDOW consecutive K-grams those with the least hash are kept (all of them on a tie), with up
    to SPAN - K words on either side. ``short`` lists lengths under SPAN of which every n-gram is kept
    (``whole``: only of items that have just that length), for items too short to hold a window.

    Columns that a lambda reads are referenced twice or more, and rows are made by explode_outer: else the
    optimizer copies their expressions into the lambda, or into a filter on the array's size.
    """
    side = SPAN - K
    hashed = df.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x))).withColumn("nw", F.size("w"))
    grams = hashed.withColumn("g", F.transform(_range(F.col("nw") - (K - 1)), lambda i: _hash_at(F.col("hw"), i, K)))
    least = grams.withColumn("least", F.transform(_range(F.size("g") - (WINDOW - 1)), lambda i: F.least(*(F.get(F.col("g"), i + k) for k in range(WINDOW)))))
    # A gram is the least of some window exactly if it equals the largest of the minima of the windows over it.
    chosen = F.filter(
        F.when(F.size("least") > 0, _range(F.size("least") + (WINDOW - 1))).otherwise(F.array().cast("array<int>")),
        lambda p: F.get(F.col("g"), p) == F.greatest(*(F.get(F.col("least"), p - k) for k in range(WINDOW))),  # out of bounds: null, ignored
    )
    long = F.transform(
        chosen,
        lambda p: _row(p, F.get(F.col("g"), p), F.lit(SPAN), F.least(p, F.lit(side)), F.slice("w", F.greatest(p - side, F.lit(0)) + 1, F.least(p, F.lit(side)) + K + side)),
    )
    parts = [long]
    for n in short:
        every = _range(F.col("nw") - (n - 1))
        at = F.when(F.col("nw") == n, every).otherwise(F.array().cast("array<int>")) if whole else every
        parts.append(F.transform(at, _short_row(n)))
    return least.withColumn("prints", F.concat(*parts)).drop("hw", "g", "least")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, n_words, spans, items, copies): one row for each distinct (id, text) of ``docs``.

    spans: the word ranges [start, end) of ``docs`` that occurrences of item windows cover, maximal and
    disjoint, in order; items: the sorted ids, as strings, of items with an occurring window; copies: how
    often the row occurs in ``docs``. A window is SPAN consecutive words of an item, or all words of a
    shorter one. Null or empty texts have no words, and neither match nor are matched; a null item id counts
    as the empty string; items repeated under several ids are all listed; other columns aren't read.
    """
    tests = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(text_of(item_text)).alias("w")).distinct()
    short = sorted(r[0] for r in tests.select(F.size("w").alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())  # under SPAN values
    theirs = winnowed(tests, short, True).select("item", F.explode_outer("prints").alias("t")).select("item", F.col("t.code").alias("code"), "t").where("code is not null")
    theirs = materialize(theirs.distinct(), "benchmark-prints")
    theirs = F.broadcast(theirs) if theirs.count() <= BROADCAST_ROWS else theirs.hint("merge")

    text = text_of(text_col)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    mark = _row(F.lit(-1), F.xxhash64("id", "text_hash").bitwiseOR(F.lit(1).cast("bigint")), F.lit(0), F.lit(0), F.array().cast("array<string>"))
    ours = winnowed(own, short, False).select("id", "text_hash", "nw", F.explode_outer(F.concat(F.array(mark), F.col("prints"))).alias("d"))
    ours = ours.select("id", "text_hash", "nw", F.col("d.code").alias("code"), "d")

    met = ours.join(theirs, "code", "left").where("item is not null or d.pos < 0")
    # Each hit is extended: which windows of SPAN words around the shared gram are equal on both sides.
    d, t = F.col("d"), F.col("t")
    part = lambda x, s: F.slice(x["context"], x["before"] - s + 1, SPAN)
    equal = F.filter(
        F.sequence(F.lit(0), F.lit(SPAN - K)),
        lambda s: (d["before"] >= s) & (t["before"] >= s) & (F.size(part(d, F.least(s, d["before"]))) == SPAN) & (part(d, F.least(s, d["before"])) == part(t, F.least(s, t["before"]))),
    )
    same = (d["n"] == t["n"]) & (d["n"] < SPAN) & (d["context"] == t["context"])
    hits = met.withColumn("s", F.when(F.col("item").isNotNull() & (d["n"] == SPAN) & (t["n"] == SPAN), equal))
    span = F.when(F.size("s") > 0, F.struct((d["pos"] - F.array_max("s")).alias("start"), (d["pos"] - F.array_min("s") + SPAN).alias("end"))).when(
        same, F.struct(d["pos"].alias("start"), (d["pos"] + d["n"]).alias("end"))
    )
    hits = hits.select("id", "text_hash", "nw", (d["pos"] < 0).alias("mark"), span.alias("span"), "item").where("mark or span is not null")
    by_doc = hits.groupBy("id", "text_hash").agg(
        F.max("nw").cast("bigint").alias("n_words"), F.sort_array(F.collect_set("span")).alias("found"), F.sort_array(F.collect_set("item")).alias("items"), F.count_if("mark").alias("copies")
    )
    merged = F.aggregate(
        "found",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(x))),
    )
    merged = F.when(F.size("found") == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(merged)
    return by_doc.select("id", "text_hash", "n_words", merged.alias("spans"), "items", "copies")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurring window of ``items``; all their columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables as in ``contamination``: what has no words stays.
    """
    bad = contamination(docs, items, id_col, text_col, item_col, item_text).where(F.size("items") > 0).select("id", F.col("text_hash").alias("bad_text"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    return rows.join(bad, F.col("own").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("bad_text")), "left_anti").select("row.*")


def op10_winnow(spark, sf_dir: str) -> DataFrame:
    """Each document's words in benchmark windows, as the contract of this query asks."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.explode(F.array_repeat(hit > 0, F.col("copies").cast("int"))).alias("contaminated"),
    )


OP10_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, s, n, item FROM dw JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
