"""URL filters by a cascade of Bloom filters over the corpus's keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import lower_ascii, materialize, table

#: Bits that a filter may have; they grow with the listed keys and the logarithm of the corpus's, not with the corpus.
MOST_BITS = 1 << 31
#: The rules (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    a, b = _mixed(h1, 2 * level + 1), _mixed(h2, 2 * level + 2) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def passes(h1: np.ndarray, h2: np.ndarray, level: int, one: tuple[int, int, np.ndarray]) -> np.ndarray:
    """Which keys, given by their two hashes, pass the filter ``one`` (bits, hashes, words) of ``level``."""
    bits, hashes, words = one
    at = _positions(h1, h2, level, hashes, bits)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def member(h1: np.ndarray, h2: np.ndarray, cascade: list) -> np.ndarray:
    """Whether keys of the universe are listed: the parity of the first level that they don't pass."""
    out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for level, one in enumerate(cascade):
        open_ &= passes(h1, h2, level, one)
        out[open_] = level % 2 == 0
    return out


def hashes_of(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def _bloom(keys: DataFrame, n: int, rate: float, level: int) -> tuple[int, int, np.ndarray]:
    """A filter of the ``n`` rows (h1, h2) of ``keys``: partitions set bits, words of 64 bits are or-ed."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits; at most {MOST_BITS} are broadcast")
    hashes = max(1, round(-math.log2(rate)))

    def words(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            at = np.unique(_positions(batch.column(0).to_numpy(), batch.column(1).to_numpy(), level, hashes, bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, hashes, out


def build(listed: DataFrame, universe: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """The cascade that tells the keys of ``listed`` from all others of ``universe`` (both: key).

    Level 0 encodes the listed keys, level 1 the universe's other keys that pass it, level 2 the listed keys
    that pass level 1, and so on until none is left. The first level's false-positive rate is the share of
    listed keys in the universe times the square root of a half, the others' a half: the levels hold a few
    bits for each listed key and binary digit of that share. Null keys don't count, keys that repeat count once;
    an empty list gives an empty cascade, which holds no key. A filter of over MOST_BITS is refused.
    """
    spark = listed.sparkSession
    yes = materialize(listed.where("key is not null").select("key", *hashes_of(F.col("key"))).distinct(), "listed")
    others = materialize(universe.where("key is not null").select("key").distinct().join(yes.select("key"), "key", "left_anti").select("key", *hashes_of(F.col("key"))), "universe")
    n, m = yes.count(), others.count()
    inside, outside, cascade = yes, others, []
    while n:
        rate = 0.5 if cascade else min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, m)))
        level = len(cascade)
        one = _bloom(inside, n, rate, level)
        cascade.append(one)
        sent = spark.sparkContext.broadcast(one)

        def through(them: Iterator[pa.RecordBatch], level=level, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in them:
                kept = passes(batch.column(0).to_numpy(), batch.column(1).to_numpy(), level, sent.value)
                yield batch.filter(pa.array(kept))

        wrong = materialize(outside.select("h1", "h2").mapInArrow(through, "h1 bigint, h2 bigint"), "passed")
        inside, outside, n = wrong, inside, wrong.count()
    return cascade


def candidates(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """The keys that could be a rule of the url: ends of the host, at a label, with starts of the path; longest first.

    ``lengths``: the lengths of the rules' hosts and paths, a few pairs.
    """
    keys = []
    for h, p in sorted(lengths, key=lambda x: (-x[0] - x[1], -x[0])):
        whole = F.char_length(host) == h
        label = (F.char_length(host) > h) & (F.substr(host, F.greatest(F.char_length(host) - h, F.lit(1)), F.lit(1)) == ".")
        keys.append(F.when((whole | label) & (F.char_length(path) >= p), F.concat(F.right(host, F.lit(h)), F.left(path, F.lit(p)))))
    return F.filter(F.array(*keys), F.isnotnull)


def judge(urls: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with its own; the
    longest wins (on a tie the one with the longer host). rule: its host and path, else null; verdict: the
    rule's, else allow, as the cascade, which holds exactly the listed keys, doesn't hold the url. A null url
    or one without ``://`` has empty host and path, and no rule; rows that repeat come back as often; other
    columns aren't read.
    """
    spark: SparkSession = urls.sparkSession
    lengths = sorted({(len(h), len(p)) for h, p, _ in rules})
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select("id", "host", "path", candidates(F.col("host"), F.col("path"), lengths).alias("keys"))
    listed = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string")
    universe = rows.select(F.explode("keys").alias("key"))
    cascades = spark.sparkContext.broadcast((build(listed, universe), build(listed.where("verdict = 'block'"), listed)))

    def judged(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_list, blocked = cascades.value
        for batch in them:
            keys, h1, h2 = (batch.column(i) for i in (3, 4, 5))
            one, two = (np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.int64) for x in (h1, h2))
            hit, block, flat, start = member(one, two, in_list), member(one, two, blocked), keys.flatten(), 0
            rule, verdict = [], []
            for n in pc.list_value_length(keys).to_pylist():
                first = next((i for i in range(start, start + n) if hit[i]), None)
                rule.append(None if first is None else flat[first].as_py())
                verdict.append("block" if first is not None and block[first] else "allow")
                start += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    kind = rows.schema["id"].dataType.simpleString()
    hashed = rows.select("id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("h2"))
    return hashed.mapInArrow(judged, f"id {kind}, host string, path string, rule string, verdict string")


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The pages' verdicts, as the contract of this query asks."""
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP2_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM s JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""
