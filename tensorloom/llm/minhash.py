"""One-permutation MinHash fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize, table, text_of

#: Bins (a power of two, a multiple of 16), bits kept of each bin's minimum, words in a shingle.
BINS, BITS, NGRAM = 256, 4, 5
#: Bins that an empty bin tries in turn, before it takes the full one of least hash.
PROBES = 12
_PER_LONG = 64 // BITS
_VALUE_BITS = 56


def _bin(h: Column) -> Column:
    return F.shiftright(h, _VALUE_BITS)  # -128 .. 127, in the order of the hashes


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` plus ``out``: the packed fingerprint of ``text``, an array of BINS * BITS / 64 bigints.

    Each shingle of NGRAM words is hashed once; the top 8 bits pick the bin and the rest is the value. One
    sentinel a bin, larger than any value, is sorted in with the hashes, so that the first entries of the
    bins are the BINS minima, in order, and an entry that is the sentinel marks an empty bin. An empty bin j
    takes the value of the first full bin among hash(j, 1), hash(j, 2), ..., mixed with j, so that one value
    borrowed by many bins doesn't give them all the same bits. Fewer words than NGRAM are one shingle;
    without words the fingerprint is zero.
    """
    w, hw, s, bins, full, dense = (f"_{out}_{x}" for x in ("w", "hw", "s", "bins", "full", "dense"))
    top = F.lit((1 << _VALUE_BITS) - 1)
    empty = lambda h: h.bitwiseAND(top) == top
    sentinels = F.array(*(F.lit(((j - BINS // 2) << _VALUE_BITS) + (1 << _VALUE_BITS) - 1).cast("bigint") for j in range(BINS)))
    df = df.withColumn(w, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn(hw, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(hw)
    shingles = F.when(n >= NGRAM, F.transform(F.sequence(F.lit(0), n - NGRAM), lambda i: F.xxhash64(*(F.get(F.col(hw), i + k) for k in range(NGRAM)))))
    shingles = shingles.when(n > 0, F.array(F.xxhash64(F.col(hw)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.sort_array(F.concat(shingles, sentinels))).drop(w, hw)
    df = df.withColumn(bins, F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(s), i - 1))))).drop(s)
    df = df.withColumn(full, F.filter(bins, lambda h: ~empty(h)))
    value = lambda j, t: F.get(F.col(bins), F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int"))
    tried = lambda j: [F.when(~empty(value(j, t)), F.xxhash64(value(j, t), j)) for t in range(PROBES)]
    least = lambda j: F.when(F.size(full) > 0, F.xxhash64(F.array_min(F.transform(full, lambda h: F.struct(F.xxhash64(j, _bin(h)).alias("k"), h.alias("h"))))["h"], j))
    df = df.withColumn(dense, F.transform(bins, lambda h, j: F.coalesce(F.when(~empty(h), h), *tried(j), least(j), F.lit(0).cast("bigint"))))
    low = F.lit((1 << BITS) - 1).cast("bigint")
    code = lambda g, i: F.get(F.col(dense), g * _PER_LONG + i).bitwiseAND(low)
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)),
        lambda g: reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(code(g, i), BITS * (_PER_LONG - 1 - i)) for i in range(_PER_LONG))),
    )
    return df.withColumn(out, packed).drop(bins, full, dense)


def likeness(x: str, y: str) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two packed fingerprints: the share r of equal codes, corrected
    for codes that agree by chance: (r - 2^-BITS) / (1 - 2^-BITS)."""
    nibbles = F.lit(int("1" * 16, 16)).cast("bigint")

    def differing(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        return F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (F.shiftrightunsigned(z, k) for k in range(BITS))).bitwiseAND(nibbles))

    count = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda n, d: n + d)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1.0 - count / float(BINS) - chance) / (1.0 - chance))


def as_hex(fp: str) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def successors(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, next_id) for each distinct id, ascending, nulls last; after the last comes the first.

    Ids are range-partitioned and numbered within partitions; only the first id of each partition (a row a
    partition) is looked at across them.
    """
    spark = ids.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("id").asc_nulls_last()
    ranged = ids.select(F.col(id_col).alias("id")).distinct().repartitionByRange(parts, order).sortWithinPartitions(order)
    ranked = materialize(ranged.withColumn("rank", F.monotonically_increasing_id()).withColumn("part", F.shiftright("rank", 33)), "ids")
    first = ranked.groupBy("part").agg(F.min(F.struct("rank", "id")).alias("first"))
    across = Window.orderBy("part")  # a row a partition
    first = first.select("part", F.coalesce(F.lead("first").over(across), F.min(F.struct("part", "first")).over(across)["first"])["id"].alias("after"))
    within = Window.partitionBy("part").orderBy("rank")
    step = ranked.select("id", "part", F.lead(F.struct("id")).over(within).alias("next"))
    return step.join(F.broadcast(first), "part").select("id", F.when(F.col("next").isNotNull(), F.col("next.id")).otherwise(F.col("after")).alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, fp, edited_fp, next_fp): a row for each of ``docs``.

    edited: the last floor(n / 4) of the n code points replaced by the first as many (or all) of the next
    document, by ascending id; after the last (nulls last) comes the first, for one document itself. Null
    texts are empty. Rows that repeat an id share their next document; of several documents with the next id
    the one whose text has the least hash counts. Other columns aren't read.
    """
    same = lambda x, y: x.eqNullSafe(y)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    own = with_fingerprint(base, F.col("text"), "fp").select("id", "text", "fp")
    wanted = base.groupBy("id").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("wanted"))
    step = successors(base, "id")
    step = step.join(wanted.withColumnRenamed("id", "_id"), same(F.col("id"), F.col("_id"))).select(F.col("id").alias("before"), "next_id", "wanted")
    after = own.join(step, same(F.col("id"), F.col("next_id"))).select("before", F.xxhash64("text").alias("k"), F.left("text", F.col("wanted")).alias("head"), F.col("fp").alias("next_fp"))
    after = after.groupBy("before").agg(F.min_by(F.struct("head", "next_fp"), "k").alias("next"))
    met = own.join(after, same(F.col("id"), F.col("before"))).select("id", "text", "fp", F.col("next.head").alias("head"), F.col("next.next_fp").alias("next_fp"))
    cut = F.floor(F.char_length("text") / 4).cast("int")
    met = met.withColumn("edited", F.concat(F.left("text", F.char_length("text") - cut), F.left("head", cut))).drop("head")
    return with_fingerprint(met, F.col("edited"), "edited_fp").select("id", "text", "edited", "fp", "edited_fp", "next_fp")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and their edited texts, as the contract of this query asks."""
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
