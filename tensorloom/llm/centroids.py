"""Centroid clustering (Lloyd's iteration) that skips distances by Drake's adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize, scratch, table

#: Centroids, components, rounds and the factor that makes components whole numbers.
CLUSTERS, WIDTH, ROUNDS, SCALE = 16, 64, 3, 64
#: Nearest other centroids whose lower bounds a vector keeps; one bound serves for the rest.
BOUNDS = 4
#: Size from which a component makes a vector's distances too large for 64 bits.
TOO_LARGE = float(1 << 21)
#: Bounds are widened by this share, far above the rounding of their sums.
MARGIN = 1e-12
#: Components below this are multiplied exactly as floats.
EXACT = 1 << 22


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, x array<int>) for the vectors of ``width`` components, none null, non-finite or ``TOO_LARGE``; x is floor(scale * component)."""
    x = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= TOO_LARGE)
    kept = vectors.where(x.isNotNull() & (F.size(x) == width) & ~F.exists(x, bad))
    return kept.select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256, in that order; of equal ids those with smaller components first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64, of each row of ``x`` to each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= WIDTH:
        a, b = x.astype(np.float64), centroids.astype(np.float64)  # every product and sum is below 2^53
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = (d * d).sum(1)
    return out


def pair_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the same row of ``centroids``."""
    d = x - centroids
    return (d * d).sum(1)


@dataclass
class Bounds:
    """For each vector its centroid, an upper bound of the distance to it, its next nearest centroids with their lower bounds, and one lower bound for all others."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    def put(self, at: np.ndarray, order: np.ndarray, squared: np.ndarray, rest: np.ndarray | None = None) -> None:
        """Takes for the rows ``at`` the centroids ``order`` with their exact squared distances, nearest first."""
        root = np.sqrt(squared.astype(np.float64))
        self.own[at], self.upper[at] = order[:, 0], root[:, 0] * (1 + MARGIN)
        self.near[at], self.lower[at] = order[:, 1 : self.near.shape[1] + 1], root[:, 1 : self.near.shape[1] + 1] * (1 - MARGIN)
        if rest is not None:
            self.rest[at] = rest


def scan(x: np.ndarray, centroids: np.ndarray, bounds: Bounds, at: np.ndarray) -> None:
    """All distances of the rows ``at``: the exact order, ties by number."""
    d = distances(x[at], centroids)
    order = np.argsort(d, axis=1, kind="stable")[:, : bounds.near.shape[1] + 2]
    d = np.take_along_axis(d, order, 1)
    kept = bounds.near.shape[1] + 1
    rest = np.sqrt(d[:, kept].astype(np.float64)) * (1 - MARGIN) if d.shape[1] > kept else np.full(len(at), np.inf)
    bounds.put(at, order[:, :kept], d[:, :kept], rest)


def assign(x: np.ndarray, centroids: np.ndarray, bounds: Bounds | None = None, moved: np.ndarray | None = None, kept: int = BOUNDS) -> tuple[Bounds, np.ndarray]:
    """The nearest centroid of each row of ``x`` (ties: the smaller number), with bounds, and how each was found.

    ``bounds`` are those of the round before, ``moved`` how far each centroid has moved since. A row whose upper
    bound is below all its lower bounds keeps its centroid (0); else its upper bound is made exact (1), then its
    stored centroids are ordered anew (2), and where even that can't certify the order all are scanned (3).
    """
    n, k = len(x), len(centroids)
    kept = min(kept, k - 1)
    how = np.zeros(n, np.int8)
    if bounds is None:
        bounds = Bounds(np.zeros(n, np.int32), np.zeros(n), np.zeros((n, kept), np.int32), np.zeros((n, kept)), np.zeros(n))
        how[:] = 3
        if n:
            scan(x, centroids, bounds, np.arange(n))
        return bounds, how
    moved = moved * (1 + MARGIN)
    bounds.upper = (bounds.upper + moved[bounds.own]) * (1 + MARGIN)
    bounds.lower = bounds.lower - moved[bounds.near] - MARGIN * np.abs(bounds.lower)
    bounds.rest = bounds.rest - moved.max(initial=0) - MARGIN * np.where(np.isfinite(bounds.rest), np.abs(bounds.rest), 0)
    least = np.minimum(bounds.lower.min(axis=1, initial=np.inf), bounds.rest)
    at = np.flatnonzero(bounds.upper >= least)
    if len(at):
        how[at] = 1
        exact = pair_distances(x[at], centroids[bounds.own[at]])
        bounds.upper[at] = np.sqrt(exact.astype(np.float64)) * (1 + MARGIN)
        at = at[bounds.upper[at] >= least[at]]
    if len(at):
        how[at] = 2
        stored = np.column_stack([bounds.own[at], bounds.near[at]])
        d = np.stack([pair_distances(x[at], centroids[stored[:, j]]) for j in range(stored.shape[1])], axis=1)
        order = np.lexsort((stored, d), axis=1)
        stored, d = np.take_along_axis(stored, order, 1), np.take_along_axis(d, order, 1)
        bounds.put(at, stored, d)
        at = at[bounds.upper[at] >= bounds.rest[at]]
    if len(at):
        how[at] = 3
        scan(x, centroids, bounds, at)
    return bounds, how


def _matrix(lists: pa.Array, width: int, kind) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


_STATE = "x array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, how tinyint, distance bigint"


def _assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, width: int, last: bool) -> DataFrame:
    """``rows`` (id, x, and from the second round on their bounds) with bounds for ``centroids``, a batch at a time; distances where it is the ``last`` time."""
    kept = min(BOUNDS, len(centroids) - 1)

    def lists(values: np.ndarray) -> pa.Array:
        n, w = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(values.reshape(-1)))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            x = _matrix(batch.column("x"), width, np.int64)
            old = None
            if moved is not None:
                plain = lambda name: batch.column(name).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                old = Bounds(plain("cluster"), plain("upper"), _matrix(batch.column("near"), kept, np.int32), _matrix(batch.column("lower"), kept, np.float64), plain("rest"))
            found, how = assign(x, centroids, old, moved)
            own = pair_distances(x, centroids[found.own]) if last else np.zeros(len(x), np.int64)
            columns = [batch.column("id"), batch.column("x"), pa.array(found.own.astype(np.int32)), pa.array(found.upper), lists(found.near.astype(np.int32)), lists(found.lower), pa.array(found.rest), pa.array(how), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "upper", "near", "lower", "rest", "how", "distance"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, {_STATE}")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to the exact floored means of their vectors; one without vectors stays."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[j].cast("bigint")).alias(f"s{j}") for j in range(width)))
    out = centroids.copy()
    for r in sums.collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, how) for every vector that is kept, and the final centroids.

    Components become floor(scale * component). ``k`` vectors drawn by id are the first centroids (all, if
    fewer are there); each of ``rounds`` rounds assigns all vectors to the nearest centroid, by squared Euclidean
    distance, ties to the smaller number, and moves the centroids to their vectors' floored means; then vectors
    are assigned once more. Bounds (``assign``) stay with the vectors, in a table that each round writes anew and
    the next deletes, so that a lost executor costs a part of a round. The driver holds ``k`` centroids and their sums.

    Vectors of another length, with null or non-finite components, or with one of ``TOO_LARGE`` or more, whose
    distances 64 bits can't hold, aren't kept. A null id draws as the empty text; rows that repeat an id, or whole
    rows, are vectors of their own; other columns aren't read; without vectors there are no rows and no centroids.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, width, scale)
    centroids = first_centroids(rows, k, seed)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance bigint, how tinyint"), np.zeros((0, width), np.int64)
    moved = None
    with scratch(spark) as drop:
        for round_ in range(rounds):
            before, rows = rows, materialize(_assigned(rows, centroids, moved, width, False), "clusters")
            if round_:
                drop(before)
            means = _means(rows, centroids)
            moved, centroids = np.sqrt(pair_distances(means, centroids).astype(np.float64)), means
        last = _assigned(rows, centroids, moved, width, True).select("id", "cluster", "distance", "how")
        return materialize(last, "clustered", keep=True), centroids


def digest(components) -> str:
    """The SHA-256 of the components, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in components).encode()).hexdigest()


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    """The embeddings' clusters and inertias, as the contract of this query asks."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    whole = sum(sums.values())
    rows = [(k, sums.get(k, 0), whole, digest(c)) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    value: Column = F.col("id").alias("vec_id")
    return found.join(F.broadcast(facts), "cluster").select(value, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings "
        f"WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {WIDTH})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"p{i} AS (SELECT r, c, sum((a - b) * (a - b))::BIGINT AS d FROM (SELECT v.r, c{i}.c, unnest(v.x) AS a, unnest(c{i}.x) AS b FROM v, c{i}) GROUP BY r, c), "
            f"a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM p{i} GROUP BY r)"
        )
        if i < ROUNDS:
            parts.append(
                f"s{i} AS (SELECT c, k, sum(a)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m.c AS c, unnest(x) AS a, unnest(range({WIDTH})) AS k FROM v JOIN a{i} USING (r)) GROUP BY c, k), "
                f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k)::BIGINT[] AS x FROM s{i} GROUP BY c), "
                f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))"
            )
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, "
        f"(sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256 FROM v JOIN {last} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.c = m.c"
    )


OP11_SQL = _sql()
