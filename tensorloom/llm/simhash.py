"""SimHash near-duplicates found through tables of distances to reference fingerprints."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize, scratch, table, text_of
from tensorloom.llm.components import components

#: The references; their distances to a fingerprint, or to a segment of it, are its coordinates.
N_PIVOTS, SEGMENTS = 16, 4
#: Members of one candidate cell up to which its pairs are compared; a larger cell is divided by the next, shorter segments.
CELL = 64
#: Near copies: words in a shingle, least Jaccard likeness, share of pairs at just that likeness that must become candidates.
NGRAM, LIKENESS, RECALL = 5, 0.8, 0.9
#: Standard deviations that the distance of two wide fingerprints may exceed the expected one by before they are discarded.
SLACK = 3.0
#: Words of 64 bits of a wide fingerprint that pairs are compared on.
CHECKED = 16
#: Comparisons with one hub that a task makes on average before another copy of the hub is dealt out.
HUB = 512


def shingles(text: bytes, ngram: int) -> list[bytes]:
    """The shingles of a UTF-8 text, with repeats; a shorter text is one shingle, no words give none."""
    words = text.lower().split()  # of bytes: A-Z only; splits at 0x20 and 0x09-0x0D only
    if not words:
        return []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(ngram)))] or [b" ".join(words)]


def _hashes(found, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, len(found))


def fingerprint(text: bytes, ngram: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text; no words give zero."""
    hashes = _hashes(shingles(text, ngram), seed)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp bigint) for every row of ``docs``; a null text is an empty one."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py() or b"", ngram, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, fp bigint")


def references(seed: int = 1) -> list[int]:
    """``N_PIVOTS`` 64-bit reference fingerprints, equal in every run."""
    draw = random.Random(seed)
    return [draw.getrandbits(64) for _ in range(N_PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ones(x: Column, pivot: int) -> Column:
    return F.bit_count(x.bitwiseXOR(F.lit(_signed(pivot)))).cast("bigint")


def _packed(values: list[Column], width: int) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(v, width * i) for i, v in enumerate(values)))


def _cut(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, near, far): the distances of each fingerprint to the 16 references, 8 bits each."""
    whole = [_ones(F.col("fp"), p) for p in references()]
    return nodes.select("fp", _packed(whole[:8], 8).alias("near"), _packed(whole[8:], 8).alias("far"))


def _divided(cells: DataFrame, width: int) -> DataFrame:
    """(fp, near, far, rest, cell): the members of ``cells`` in the six cells of the pairs of segments of ``width`` bits.

    A cell's key is the vectors of the distances of two segments to the references' segments (and the cell it is
    part of); ``rest`` becomes the other two segments.
    """
    pivots = references()
    segment = [_cut(F.col("rest"), width * s, width) for s in range(SEGMENTS)]
    table_of = lambda s: F.xxhash64(*(_packed([_ones(segment[s], (p >> width * s) % (1 << width)) for p in pivots[i : i + 8]], 8) for i in (0, 8)))
    keyed = cells.select("fp", "near", "far", "rest", "cell", F.array(*map(table_of, range(SEGMENTS))).alias("k"))
    options = []
    for i, (s, t) in enumerate(combinations(range(SEGMENTS), 2)):
        u, v = (x for x in range(SEGMENTS) if x not in (s, t))
        options.append(F.struct(F.xxhash64("cell", F.lit(i), F.col("k")[s], F.col("k")[t]).alias("cell"), segment[u].bitwiseOR(F.shiftleft(segment[v], width)).alias("rest")))
    return keyed.select("fp", "near", "far", F.explode(F.array(*options)).alias("o")).select("fp", "near", "far", "o.rest", "o.cell")


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints ``nodes`` (fp) at ``max_bits`` (0 to 2) or fewer bits.

    At two differing bits at least two of the four 16-bit segments agree, and with them all their distances to
    the references: fingerprints meet in the cells of the six pairs of segments. A cell of over ``CELL`` members
    is divided alike: of the 32 bits that don't agree for certain, two of four 8-bit segments do, and then two of
    four 4-bit segments. What remains has 8 open bits, 256 members at most. In a cell a pair is discarded when
    any of its 16 coordinates differs by more than ``max_bits`` (the triangle inequality), and survivors are
    verified on all bits.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")

    def gap(i: int) -> Column:
        side, at = ("near", 8 * i) if i < 8 else ("far", 8 * (i - 8))
        return F.abs(_cut(F.col(f"x.{side}"), at, 8) - _cut(F.col(f"y.{side}"), at, 8))

    near = F.greatest(*(gap(i) for i in range(N_PIVOTS))) <= max_bits
    real = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits

    def pairs(members: DataFrame) -> DataFrame:
        x, y = members.alias("x"), members.alias("y")
        return x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & near & real).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    rows, found = pivot_table(nodes).withColumn("rest", F.col("fp")).withColumn("cell", F.lit(0).cast("bigint")), None
    for width in (16, 8, 4):
        cells = materialize(_divided(rows, width), "cells")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(cells.join(sizes, "cell"), "met")
        own = pairs(met if width == 4 else met.where(F.col("n") <= CELL))
        found = own if found is None else found.union(own)
        rows = met.where(F.col("n") > CELL).drop("n")
        if width == 4 or not rows.limit(1).count():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp bigint, component): one row for each row of ``docs``.

    component is the smallest id of all documents whose fingerprints a chain of links reaches. Exact copies
    share a fingerprint and never meet as pairs. Null texts are empty; empty texts share fingerprint zero;
    repeated rows come back as often as they came; a null id is ignored as a minimum (null if no other);
    an empty table gives no rows; other columns aren't read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    label = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component"))
    by_fp = rooted.join(whole, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


# Near copies: wide fingerprints, verified by likeness


def angle(likeness: float) -> float:
    """The share of fingerprint bits in which two texts of as many shingles differ that have this Jaccard likeness."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def plan(n: int, least: float = LIKENESS, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a segment, segments) for ``n`` texts.

    Unlike texts meet in a segment of log2(n) + 2 bits with a quarter of a neighbour each; there are as many
    segments as make pairs at likeness ``least`` agree in one with probability ``recall``.
    """
    width = max(8, math.ceil(math.log2(max(2, n))) + 2)
    return width, max(math.ceil(math.log(1 - recall) / math.log(1 - (1 - angle(least)) ** width)), math.ceil(64 * CHECKED / width))


def wide_bits(hashes: np.ndarray, mask: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The bits (0 or 1) of the wide fingerprint: each word of 64 by its own mixing of the shingles' hashes."""
    ones = np.zeros(64 * len(mask), np.int64)
    for at in range(0, len(hashes), 255):
        mixed = (hashes[at : at + 255, None] ^ mask) * odd
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def wide_fingerprints(rows: DataFrame, n: int, ngram: int = NGRAM, least: float = LIKENESS, seed: int = 1) -> DataFrame:
    """(hash, id, f0 .. f15 bigint, cells array<bigint>) for ``rows`` (hash bigint, id, text), of which there are ``n``.

    A cell is a hash of a segment's number and of its distances to the references' segments; f0 .. f15 are the
    first 1024 bits.
    """
    width, segments = plan(n, least)
    draw = np.random.default_rng(seed)
    size = -(-width * segments // 64)
    mask, odd = draw.integers(0, 2**64, size, np.uint64), draw.integers(0, 2**64, size, np.uint64) | np.uint64(1)
    signs = 1 - 2 * draw.integers(0, 2, (width, 2 * N_PIVOTS)).astype(np.float32)  # x @ signs: the distances, less each reference's ones
    weights = draw.integers(0, 2**63, (segments, 2 * N_PIVOTS), np.uint64) | np.uint64(1)
    words = [f"f{i}" for i in range(CHECKED)]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            first, cells = [], []
            for text in batch.column(2).cast(pa.binary()):
                bits = wide_bits(_hashes({*shingles(text.as_py(), ngram)}, 42), mask, odd)
                first.append(np.packbits(bits[: 64 * CHECKED]).view(np.int64))
                away = (bits[: width * segments].reshape(segments, width).astype(np.float32) @ signs).astype(np.int64).view(np.uint64)
                key = (away * weights).sum(axis=1, dtype=np.uint64) + np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                cells.append((key ^ (key >> np.uint64(31))).view(np.int64))
            columns = [pa.array(c) for c in np.array(first).reshape(-1, CHECKED).T]
            flat = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * segments), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, lists], names=["hash", "id", *words, "cells"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("hash", "id", "text").mapInArrow(batches, f"hash bigint, id {kind}, {', '.join(f'{w} bigint' for w in words)}, cells array<bigint>")


def most_bits(least: float) -> int:
    """The distance on the checked bits up to which a pair may be alike, by ``SLACK`` standard deviations."""
    p, n = angle(least), 64 * CHECKED
    return math.floor(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def _apart(x: str, y: str) -> Column:
    return reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.f{i}").bitwiseXOR(F.col(f"{y}.f{i}"))) for i in range(CHECKED)))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, least: float = LIKENESS, ngram: int = NGRAM) -> DataFrame:
    """The rows of ``pairs`` (hub, node), each given once, whose texts are alike by exact Jaccard likeness; as (a, b).

    ``nodes``: (node, hash); ``rows``: (hash, text), whose copies meet within tasks first.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, set()
        for batch in them:
            keep = []
            for h, a, b in zip(batch.column(0), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if hub != h.as_py():
                    hub, own = h.as_py(), {*shingles(a.as_py(), ngram)}
                other = {*shingles(b.as_py(), ngram)}
                both = len(own & other)
                keep.append(both >= least * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    wanted = nodes.select("node", "hash").join(wanted, "node")
    texts = materialize(rows.select("hash", "text").join(wanted, "hash").groupBy("node").agg(F.first("text").alias("text")), "held")
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB).alias("parts"))
    own = many.join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", F.col("text").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(many, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    rows = dealt.join(texts, "node").join(own, ["hub", "part"])
    return rows.select("hub", "node", "own", "text").mapInArrow(batches, "a bigint, b bigint")


def near_links(wide: DataFrame, rows: DataFrame, least: float = LIKENESS, ngram: int = NGRAM) -> DataFrame:
    """(a, b) edges that connect exactly the texts of ``wide`` (node, hash, f0.., cells) that share a cell and are alike; ``rows`` holds (hash, text).

    Most cells hold two unlike texts that meet by chance; those pairs come out of the count of the cells. In
    larger cells each member is first compared with one hub, the one with the most neighbours: in a group of
    edited copies mostly the text they come from. Then the pairs that share a cell and aren't connected yet are
    compared. Of all these only pairs within ``most_bits`` on the wide fingerprints are compared on their shingles.
    """
    prints = wide.drop("cells", "hash", "id")
    x, y, far = prints.alias("x"), prints.alias("y"), most_bits(least)
    members = wide.select("node", F.explode("cells").alias("cell"))
    sizes = materialize(members.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("node")).where("n > 1"), "sizes")
    met = materialize(members.join(sizes.where("n > 2").select("cell", "n"), "cell"), "met")
    weight = met.groupBy("node").agg(F.sum("n").alias("w"))
    hubs = met.join(weight, "node").groupBy("cell").agg(F.max(F.struct("w", "node")).alias("hub"))
    best = met.join(hubs, "cell").where("hub.node <> node").groupBy("node").agg(F.max("hub")["node"].alias("hub")).select("hub", "node")
    tried = sizes.where("n = 2").select("hub", "node").union(best).distinct()
    near = tried.alias("t").join(x, F.col("t.hub") == F.col("x.node")).join(y, F.col("t.node") == F.col("y.node")).where(_apart("x", "y") <= far)
    near = materialize(near.select("t.hub", "t.node"), "stars")
    edges = materialize(verified(near, wide, rows, least, ngram), "links")

    label = materialize(components(edges), "labels")
    named = met.select("cell", "node").join(label, "node", "left").select("cell", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
    open_ = materialize(named.join(mixed, "cell").join(prints, "node"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    meet = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (_apart("x", "y") <= far)
    rest = x.join(y, meet).select(F.col("x.node").alias("hub"), F.col("y.node").alias("node")).distinct()
    past = near.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
    rest = materialize(rest.join(past, ["hub", "node"], "left_anti"), "pairs")
    return edges.union(verified(rest, wide, rows, least, ngram))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS, ngram: int = NGRAM) -> DataFrame:
    """(hash, id, root): each distinct text's hash, the least id of its rows, and the label of its component.

    Texts are linked from a Jaccard likeness of ``least`` of their distinct shingles on, A-Z lower-cased, if their
    fingerprints share a segment (``plan``); null texts are empty, and texts without words are alike; an empty
    table gives no rows.
    """
    text = text_of(text_col)
    rows = docs.select(F.xxhash64(text).alias("hash"), F.col(id_col).alias("id"), text.alias("text"))
    every = wide_fingerprints(rows, rows.count(), ngram, least)
    one = every.groupBy("hash").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in every.columns[2:]))  # of copies, within tasks first
    wide = materialize(one.withColumn("node", F.monotonically_increasing_id()), "wide")
    label = components(near_links(wide, rows, least, ngram))
    return wide.select("node", "hash", "id").join(label, "node", "left").select("hash", "id", F.coalesce("label", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS, ngram: int = NGRAM) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``near_copies`` one, of the smallest id (null as the largest).

    A copy under an id that other texts bear too goes; a row repeated stays once. All columns come back,
    whatever their names; an empty table gives no rows.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    with scratch(docs.sparkSession):
        known = near_copies(docs, id_col, text_col, least, ngram)
        kept = materialize(known.groupBy("root").agg(first.alias("f")).select(F.col("f.hash").alias("hash"), F.col("f.id").alias("id")), "kept", keep=True)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_of(text_col)).alias("hash"))
    return rows.join(kept, "hash").where(F.col("own").eqNullSafe(F.col("id"))).dropDuplicates(["hash"]).select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """The documents' fingerprints and components, as the contract of this query asks."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
