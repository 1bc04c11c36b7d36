"""Orderings and relabelings. A DataFrame has no order of its own: sorts can add positions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import TensorValueError
from tensorloom.functions.keys import morton
from tensorloom.operators.positions import with_pos
from tensorloom.operators.reshape import relabel
from tensorloom.storage import materialize, scratch
from tensorloom.tensor import SemiSparseTensor, SparseTensor

#: Ranks that one row of ``lexi_order`` holds at most.
GATHER = 1024


def sort_custom(x: SparseTensor, order: Sequence[int], force: bool = False) -> SparseTensor:
    """By the modes in ``order``; nothing happens if that is the known order."""
    if sorted(order) != list(range(x.nmodes)):
        raise TensorValueError(f"{order} is no order of {x.nmodes} modes")
    if not force and x.sortorder == tuple(order):
        return x
    return x.with_df(x.df.orderBy(*(f"i{k}" for k in order)), order)


def sort_lexi(x: SparseTensor, force: bool = False) -> SparseTensor:
    return sort_custom(x, range(x.nmodes), force)


def sort_at_mode(x: SparseTensor, mode: int, force: bool = False) -> SparseTensor:
    """``mode`` last."""
    x.check_mode(mode)
    return sort_custom(x, [*(k for k in range(x.nmodes) if k != mode), mode], force)


def sort_semisparse(y: SemiSparseTensor) -> SemiSparseTensor:
    """Fibers by their sparse modes, in order."""
    return SemiSparseTensor(y.df.orderBy(*y.rest), y.ndims, y.mode)


def except_mode_keys(x: SparseTensor, mode: int) -> list[str]:
    return x.rest(mode)


def rowblock_keys(x: SparseTensor, sk_bits: int) -> list[Column]:
    return [F.shiftright(m, sk_bits) for m in x.modes]


def morton_keys(x: SparseTensor, bits: int | None = None) -> list[Column]:
    width = bits or max(1, max(d - 1 for d in x.ndims).bit_length())
    return morton([F.col(m) for m in x.modes], width)


def mixed_keys(x: SparseTensor, sk_bits: int) -> list[Column]:
    """Row blocks, and Z-order within each."""
    return [*rowblock_keys(x, sk_bits), *morton_keys(x)]


def partial_keys(x: SparseTensor, order: Sequence[int], sb_bits: int) -> list[Column]:
    """Slices of the first mode of ``order``, and row blocks of the modes within each."""
    return [F.col(f"i{order[0]}"), *(F.shiftright(f"i{k}", sb_bits) for k in order)]


def sort_by(x: SparseTensor, keys: Sequence[Column | str]) -> SparseTensor:
    """By any keys; the lexicographic order isn't claimed afterwards."""
    return x.with_df(x.df.orderBy(*keys))


def distribute(x: SparseTensor, parts: int, mode: int = 0) -> SparseTensor:
    """Dealt out by ranges of ``mode`` with about as many entries each."""
    return x.with_df(x.df.repartitionByRange(parts, f"i{mode}"))


def colocate(x: SparseTensor, parts: int, mode: int) -> SparseTensor:
    """Dealt out by hash of ``mode``, to be cached: contractions of any other mode then sum without a shuffle."""
    x.check_mode(mode)
    return x.with_df(x.df.repartition(parts, f"i{mode}"))


def shuffle_entries(x: SparseTensor, seed: int = 0) -> SparseTensor:
    """A random order, equal for equal seeds."""
    return x.with_df(x.df.orderBy(F.xxhash64(*x.modes, F.lit(seed)), *x.modes))


def random_maps(spark, ndims: Sequence[int], seed: int = 0) -> DataFrame:
    """(mode, old, new): a random permutation of every mode's indices."""
    maps = None
    for k, d in enumerate(ndims):
        one = with_pos(spark.range(d).select(F.lit(k).alias("mode"), F.col("id").alias("old")), [F.xxhash64("old", F.lit(seed + k)), F.col("old")]).withColumnRenamed("pos", "new")
        maps = one if maps is None else maps.unionByName(one)
    return maps


def lexi_order(x: SparseTensor, mode: int, gather: int = GATHER) -> DataFrame:
    """(mode, old, new): indices of ``mode`` ordered by the ranks of the other-mode tuples they occur with.

    Indices hit by earlier tuples come first; one whose tuples are a prefix of another's comes after it;
    unused indices come last, ties keep the index order. An index's ranks are gathered in runs of ``gather``; where an
    index has more, the runs are ranked themselves and these ranks gathered in turn, so that no row grows with a hot
    index: a round more for each power of ``gather``.
    """
    rest = x.rest(mode)
    tuples = with_pos(x.df.select(*rest).distinct(), rest).withColumnRenamed("pos", "rank")
    used = x.df.select(F.col(f"i{mode}").alias("old"), *rest).distinct().join(tuples, rest).select("old", "rank")
    placed = with_pos(used, ["old", "rank"])
    starts = materialize(placed.groupBy("old").agg(F.min("pos").alias("start"), F.count("*").alias("n")), "starts")
    most = starts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ranks = placed.join(starts.select("old", "start"), "old").select("old", (F.col("pos") - F.col("start")).alias("at"), "rank")
    run = F.transform(F.sort_array(F.collect_list(F.struct("at", "rank"))), lambda r: r["rank"])
    while True:
        runs = ranks.groupBy("old", F.floor(F.col("at") / gather).alias("at")).agg(F.concat(run, F.array(F.lit(2**63 - 1))).alias("run"))
        if most <= gather:
            break
        runs = materialize(runs, "runs")
        ranked = with_pos(runs.select("run").distinct(), ["run"]).withColumnRenamed("pos", "rank")
        ranks, most = runs.join(ranked, "run").select("old", "at", "rank"), -(-most // gather)
    every = x.df.sparkSession.range(x.ndims[mode]).withColumnRenamed("id", "old").join(runs.select("old", "run"), "old", "left")
    return with_pos(every, [F.col("run").asc_nulls_last(), F.col("old")]).select(F.lit(mode).alias("mode"), "old", F.col("pos").alias("new"))


def bfs_order(x: SparseTensor, mode: int) -> DataFrame:
    """(mode, old, new): indices of ``mode`` by breadth-first levels over the tuples of the other modes they share.

    In every component levels start at its most frequent index (the smallest of several). Components come by
    the frequency of that index, then by the index; within a component lower levels come first, within a level
    more frequent indices, then smaller ones; unused indices come last. A round hands (start, level) on from the
    indices that changed, to their tuples and back, until none changes: as many as there are levels, or, while
    starts of a component still compete, up to its longest shortest path.
    """
    x.check_mode(mode)
    rest, own = x.rest(mode), f"i{mode}"
    with scratch(x.df.sparkSession) as drop:
        links = materialize(x.df.select(F.col(own).alias("old"), F.xxhash64(*rest).alias("edge")).distinct(), "links")
        degree = links.groupBy("old").agg(F.count("*").alias("n"))
        state = materialize(degree.select("old", F.struct((-F.col("n")).alias("rare"), F.col("old").alias("start"), F.lit(0).alias("level")).alias("at")), "levels")
        front = state
        further = lambda s: F.struct(s["rare"].alias("rare"), s["start"].alias("start"), (s["level"] + 1).alias("level"))
        while front.limit(1).count():
            edges = links.join(front, "old").groupBy("edge").agg(F.min("at").alias("at"))
            near = links.join(edges, "edge").groupBy("old").agg(F.min(further(F.col("at"))).alias("new"))
            changed = materialize(state.join(near, "old").where("new < at").select("old", F.col("new").alias("at")), "front")
            before, state = state, materialize(state.join(changed.withColumnRenamed("at", "new"), "old", "left").select("old", F.coalesce("new", "at").alias("at")), "levels")
            drop(before)
            front = changed
        every = x.df.sparkSession.range(x.ndims[mode]).withColumnRenamed("id", "old").join(degree, "old", "left").join(state, "old", "left")
        keys = [F.col("at").isNull(), F.col("at.rare"), F.col("at.start"), F.col("at.level"), F.col("n").desc(), F.col("old")]
        return materialize(with_pos(every, keys).select(F.lit(mode).alias("mode"), "old", F.col("pos").alias("new")), "order", keep=True)


def _batches(pins: DataFrame, growth: float, drop) -> DataFrame:
    """(old, label, turn, place): the vertices of ``pins`` (old, pin, n) in the batches of ``mcs_order``; label is the seed that a vertex comes from."""
    degree = pins.groupBy("old").agg(F.sum("n").alias("degree"))
    left = materialize(degree.select("old", "degree", F.lit(0).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("label")), "left")
    touched = materialize(pins.select("pin").limit(0), "touched")
    out, taken, turn, total = [left.select("old", "label", F.lit(0).alias("turn"), F.col("key").alias("place")).limit(0)], 0, 0, left.count()
    while taken < total:
        size = min(total - taken, max(1, int(taken * growth)))
        ranked = with_pos(left, [F.col("key").desc(), F.col("degree").desc(), F.col("old")])
        batch = materialize(ranked.where(F.col("pos") < size).select("old", F.coalesce("label", F.col("pos") + taken).alias("label"), F.lit(turn).alias("turn"), F.col("pos").alias("place")), "batch")
        out.append(batch)
        # Pins reached for the first time, with the least label that reaches them, raise the keys of all they hold.
        new = materialize(pins.join(batch, "old").groupBy("pin").agg(F.min("label").alias("from")).join(touched, "pin", "left_anti"), "pins")
        raised = pins.join(new, "pin").groupBy("old").agg(F.sum("n").alias("more"), F.min("from").alias("from"))
        rest = ranked.where(F.col("pos") >= size).join(raised, "old", "left")
        before, left = left, materialize(rest.select("old", "degree", (F.col("key") + F.coalesce("more", F.lit(0))).alias("key"), F.coalesce(F.least("label", "from"), "label", "from").alias("label")), "left")
        drop(before)
        before, touched = touched, materialize(touched.union(new.select("pin")), "touched")
        drop(before)
        taken, turn = taken + size, turn + 1
    return reduce(DataFrame.unionByName, out)


def _by_links(pins: DataFrame, growth: float, drop) -> DataFrame:
    """(old, pos): the vertices of ``pins`` in their new order."""
    found = materialize(_batches(pins, growth, drop), "batches")
    n, labels = found.agg(F.count("*"), F.count_distinct("label")).first()
    keys = ["turn", "place"]
    if growth and 1 < labels < n:
        # Each seed's vertices are one vertex of a smaller problem, and come where it comes.
        merged = materialize(pins.join(found.select("old", "label"), "old").groupBy(F.col("label").alias("old"), "pin").agg(F.sum("n").alias("n")), "merged")
        place = _by_links(merged, growth, drop).select(F.col("old").alias("label"), F.col("pos").alias("group"))
        found, keys = found.join(place, "label"), ["group", *keys]
    return materialize(with_pos(found, keys).select("old", "pos"), "placed")


def mcs_order(x: SparseTensor, mode: int, growth: float = 7.0) -> DataFrame:
    """(mode, old, new): indices of ``mode`` by maximum-cardinality search, in batches.

    The next index is the one with most entries that share another mode's index with those taken before, of several
    the one with more entries, then the smaller. With ``growth`` 0 indices are taken one by one. With more, a batch
    takes ``growth`` times as many as were taken before it, so that batches are few (logarithmically many), however
    long the tensor's paths; an index that no taken one reaches is a seed then, those reached belong to the earliest seed that
    does, and the seeds' groups are ordered by the same search again, on ever fewer of them. Unused indices come last.
    """
    x.check_mode(mode)
    if growth < 0:
        raise TensorValueError(f"growth {growth}")
    spark = x.df.sparkSession
    with scratch(spark) as drop:
        others = F.explode(F.array(*(F.xxhash64(F.lit(k), f"i{k}") for k in range(x.nmodes) if k != mode)))
        pins = materialize(x.df.select(F.col(f"i{mode}").alias("old"), others.alias("pin")).groupBy("old", "pin").agg(F.count("*").alias("n")), "pins")
        placed = _by_links(pins, growth, drop) if x.nmodes > 1 else spark.createDataFrame([], "old bigint, pos bigint")
        every = spark.range(x.ndims[mode]).withColumnRenamed("id", "old").join(placed, "old", "left")
        new = with_pos(every.withColumnRenamed("pos", "at"), [F.col("at").asc_nulls_last(), F.col("old")])
        return materialize(new.select(F.lit(mode).alias("mode"), "old", F.col("pos").alias("new")), "order", keep=True)


def renumber(x: SparseTensor, how: str, iterations: int = 1, seed: int = 0) -> DataFrame:
    """Maps for all modes: ``lexi`` (modes in turn, again and again), ``bfs``, ``mcs`` or ``random``."""
    spark = x.df.sparkSession
    if how == "random":
        return random_maps(spark, x.ndims, seed)
    if how == "bfs":
        maps = [bfs_order(x, k) for k in range(x.nmodes)]
    elif how == "mcs":
        maps = [mcs_order(x, k) for k in range(x.nmodes)]
    elif how == "lexi":
        maps = [spark.range(d).select(F.lit(k).alias("mode"), F.col("id").alias("old"), F.col("id").alias("new")) for k, d in enumerate(x.ndims)]
        for _ in range(iterations):
            for k in range(x.nmodes):
                step = lexi_order(x, k)
                keep = [step if j == k else spark.range(d).select(F.lit(j).alias("mode"), F.col("id").alias("old"), F.col("id").alias("new")) for j, d in enumerate(x.ndims)]
                whole = keep[0]
                for one in keep[1:]:
                    whole = whole.unionByName(one)
                x = x.with_df(materialize(relabel(x, whole).df, "relabelled"))
                maps[k] = maps[k].withColumnRenamed("new", "_mid").join(step.select(F.col("old").alias("_mid"), "new"), "_mid").select("mode", "old", "new")
    else:
        raise TensorValueError(f"{how!r}: lexi, bfs, mcs or random")
    out = maps[0]
    for one in maps[1:]:
        out = out.unionByName(one)
    return out
