"""Clusters, fill-in-middle and the language model against brute-force versions, on rows with every odd case, and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import centroids, fim, pitman_yor, registry
from tensorloom.storage import scratch
from tests.llm.conftest import SCHEMA, prose, rows

SF = "/root/testdata/sf0.001"
TEXTS = [(r[0], r[1] or "") for r in rows()]

# Fill-in-middle


def slow_forms(id_, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


ODD = ["\x01", "\x02", "\x020\x021\x01\x02", "a\x01b\x02c1\x020", "<P", "<<S", "x<P>y", "<M><S>", "\U0001f600\U0001f601ab́c", "\n\r\n\x00\t", "<", "ab" * 500 + "1" * 500, " \u0085 z"]


def test_fill_in_middle(spark, docs):
    extra = [(100 + 20 * i + k, t, None, None, None, None, None, None, None, None, None) for i, t in enumerate(ODD) for k in range(8)]
    every = docs.union(spark.createDataFrame(extra, SCHEMA))
    got = fim.fill_in_middle(every).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = TEXTS + [(r[0], r[1]) for r in extra]
    assert sorted((str(r["id"]), r["text"], r["n"], r["form"], str(r["prefix"]), str(r["middle"]), str(r["suffix"]), r["output"]) for r in got) == sorted((str(i), t, n, f, str(p), str(m), str(s), o) for i, t in want for n, f, p, m, s, o in [slow_forms(i, t)])
    assert all(r["back"] == r["text"] for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(none):
    assert fim.fill_in_middle(none).collect() == []


# Clusters


def slow_clusters(vectors, k, rounds):
    x = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in vectors]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in x]
        if turn < rounds:
            for c in range(len(at)):
                mine = [v for (_, v), o in zip(x, own) if o == c]
                if mine:
                    at[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((str(i), o, far(v, at[o])) for (i, v), o in zip(x, own)), at


VECTORS = "vec_id bigint, embedding array<float>, label int, id bigint, x string, cluster string"


def vectors_of(n, seed, width=64, scale=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(7, width)) * scale
    return [(i, [float(np.float32(c)) for c in middle[i % 7] + draw.normal(size=width) * 0.4 * scale]) for i in range(n)]


@pytest.mark.parametrize("n, k, scale", [(120, 16, 1.0), (60, 3, 1.0), (40, 16, 3e4), (9, 16, 1.0), (5, 1, 1.0)])
def test_clusters(spark, n, k, scale):
    good = vectors_of(n, n, scale=scale)
    good += [good[0], good[0], (None, good[1][1]), (7, [0.0] * 64), (8, [0.0] * 64)]  # repeated rows and ids, a null id, ties
    bad = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [float("nan")] + [0.0] * 63), (1005, [float("inf")] * 64), (1006, [None] + [0.0] * 63), (1007, [3e38] * 64)]
    table = spark.createDataFrame([(*r, None, 5, "x", "y") for r in good + bad], VECTORS)
    found, at = centroids.cluster(table, k=k)
    want, final = slow_clusters(good, k, centroids.ROUNDS)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in found.collect()) == want and at.tolist() == final


def test_clusters_of_nothing(spark):
    found, at = centroids.cluster(spark.createDataFrame([], VECTORS))
    assert found.collect() == [] and at.shape == (0, 64)


def test_bounds_spare_scans():
    """Exact in every round, ties included, and most rows aren't scanned once centroids move little."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.integers(-40, 40, (12, 8))[draw.integers(0, 12, 800)] * 3 + draw.integers(-6, 7, (800, 8)), np.zeros((40, 8), np.int64), draw.integers(-1, 2, (100, 8))])
    at = np.unique(x, axis=0)[::40][:20].copy()
    bounds, moved, hows = None, None, []
    for _ in range(12):
        bounds, how = centroids.assign(x, at, bounds, moved)
        exact = ((x[:, None, :] - at[None]) ** 2).sum(-1)
        assert (bounds.own == exact.argmin(1)).all()
        near = np.take_along_axis(exact, bounds.near, 1)
        assert (bounds.lower <= np.sqrt(near)).all() and (bounds.upper >= np.sqrt(exact.min(1))).all()
        others = exact.astype(float)
        np.put_along_axis(others, bounds.near, np.inf, 1)
        np.put_along_axis(others, bounds.own[:, None], np.inf, 1)
        assert (bounds.rest <= np.sqrt(others.min(1))).all()
        hows.append(how)
        new = np.array([np.floor(x[bounds.own == c].mean(0)) if (bounds.own == c).any() else at[c] for c in range(len(at))]).astype(np.int64)
        moved, at = np.sqrt(((new - at) ** 2).sum(1)), new
    assert (hows[0] == 3).all() and (hows[-1] == 3).mean() < 0.2 and {*np.concatenate(hows).tolist()} == {0, 1, 2, 3}


def test_distances_of_large_components():
    x = np.array([[1 << 26, -(1 << 26)], [5, -7]], np.int64)
    at = np.array([[-(1 << 26), 1 << 26], [0, 0], [5, -7]], np.int64)
    assert centroids.distances(x, at).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in at] for r in x]


# The language model


def slow_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]


def held(id_, mod=7, rest=2):
    return zlib.crc32(str("" if id_ is None else id_).encode()) % mod == rest


def check_base(got, docs):
    train = [t for i, t in docs if not held(i)]
    counts = collections.Counter(w for t in train for w in slow_tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        words = slow_tokens(t)
        want.append((str(i), held(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    found = sorted((str(r[0]), r[1], r[2], r[3], r[4], r[5]) for r in got)
    for f, w in zip(found, sorted(want), strict=True):
        assert f[:5] == w[:5] and f[5] == pytest.approx(w[5], rel=1e-9)


def scored(df, id_col="doc_id"):
    return pitman_yor.score_texts(df, F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2)


def test_language_model_on_odd_rows(docs):
    got = scored(docs).collect()
    check_base([(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], TEXTS)
    assert all(-400 * r["n_tokens"] < r["score"] < 0 for r in got)
    again = scored(docs.repartition(3)).collect()
    key = lambda r: (str(r["id"]), r["n_tokens"], r["base_score"])
    assert [r["score"] for r in sorted(again, key=key)] == pytest.approx([r["score"] for r in sorted(got, key=key)], rel=1e-6)


def test_language_model_of_nothing(spark, none):
    assert scored(none).collect() == []
    only = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    got = pitman_yor.score_texts(only, F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2


def test_op13(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.QUERIES["op13_model"](spark, SF).collect()
    check_base([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], docs)
    for out in (True, False):
        base, score = (sum(r[c] for r in got if r["held_out"] == out) for c in ("base_score", "score"))
        assert score > 0.95 * base  # of the logarithms: better than counts, on texts that weren't seen too


def test_scores_are_the_model(spark, monkeypatch):
    """Probabilities after every context sum to one, and scores are sums of what the counts and seatings give, chunk by chunk."""
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 64)
    monkeypatch.setattr(pitman_yor, "HELD", 20)
    monkeypatch.setattr(pitman_yor, "HOT", 100)
    texts = [prose(i % 5, 40) + " the cat " * (i % 7) + prose(100 + i, 5) for i in range(30)]
    docs = spark.createDataFrame([(i, i % 6 == 0, t) for i, t in enumerate(texts)], "id bigint, held_out boolean, text string")
    with scratch(spark):
        model = pitman_yor.train(docs.select((~F.col("held_out")).alias("train"), "text"))
        words = {r["w"] % (1 << 64): r for r in model.words.collect()}
        k = len(model.samples)

        def tokens(text):
            chunk = pitman_yor.Chunk()
            chunk.add(text.encode())
            hashes, number, contexts, _ = chunk.read()
            return list(zip(hashes[number.astype(int)].tolist(), contexts.tolist()))

        counts = collections.Counter()
        for i, t in enumerate(texts):
            if i % 6:
                counts.update(tokens(t))

        def probability(w, u):
            r = words.get(w)
            n = counts[w, u]
            if r is None or r["c"] < 2:
                m = t = [r["c"] if r else 0] * k
                seats = k * min(1, n)
            else:
                at, ns = np.frombuffer(r["us"], np.uint16).tolist(), np.frombuffer(r["ns"], np.int64)
                assert [counts[w, c] for c in at] == ns.tolist()
                big = [c for c, x in zip(at, ns) if x > 1]
                seats = int(np.frombuffer(r["seats"], np.int64)[big.index(u)]) if u in big else k * min(1, n)
                m, t = np.frombuffer(r["ms"], np.int64), np.frombuffer(r["rs"], np.int64)
                assert (t <= m).all() and (m <= k * r["c"]).all() and (not n or n * k >= seats >= k)
            p = 0.0
            for s, of in enumerate(model.samples):
                root = (m[s] - model.root_discount * t[s] + (1 + model.root_discount * of.root_tables) / (model.types + 1)) / (of.customers + 1)
                p += (n - model.discount * seats / k + (1 + model.discount * of.tables[u]) * root) / (model.customers[u] + 1)
            return p / k

        seen = [w for w, r in words.items() if r["c"]]
        for u in sorted({u for _, u in counts})[:12] + [next(u for u in range(65536) if not model.customers[u])]:
            assert sum(probability(w, u) for w in seen) + probability(-1, u) == pytest.approx(1, abs=1e-9)
        got = {r["id"]: r for r in pitman_yor.scores(docs, model).collect()}
        for i, t in enumerate(texts):
            pairs = tokens(t)
            assert got[i]["tokens"] == len(pairs) and got[i]["score"] == pytest.approx(sum(math.log10(probability(w, u)) for w, u in pairs), rel=1e-5)


def rising(x, n):
    return math.prod(x + i for i in range(n))


def test_seating_has_the_right_distribution():
    """Tables of three and four customers after many sweeps, against all partitions' weights."""
    a, d, dishes = 1.3, 0.4, 20_000
    key = np.arange(dishes, dtype=np.uint64) * np.uint64(7919)
    for n, parts in ((3, [((3,), 1), ((2, 1), 3), ((1, 1, 1), 1)]), (4, [((4,), 1), ((3, 1), 4), ((2, 2), 3), ((2, 1, 1), 6), ((1,) * 4, 1)])):
        weight = {p: ways * a ** len(p) * math.prod(rising(1 - d, s - 1) for s in p) for p, ways in parts}
        whole, want = sum(weight.values()), np.full(dishes, n)
        sizes, seats = pitman_yor.seated(want, np.full(dishes, a), d, pitman_yor.mixed(key))
        for sweep in range(6):
            sizes, seats = pitman_yor.reseated(sizes, seats, want, np.full(dishes, a), d, pitman_yor.mixed(key + np.uint64(sweep + 1)))
        assert sizes.sum() == n * dishes
        found = collections.Counter(tuple(sorted(map(int, s), reverse=True)) for s in np.split(sizes, np.cumsum(seats)[:-1]))
        for p, w in weight.items():
            assert found[p] / dishes == pytest.approx(w / whole, abs=0.015)


def test_customers_come_and_go():
    """The sizes add up to the customers wanted, of dishes with one to very many, and hot ones start in blocks."""
    n = np.array([1, 2, 5, 70, 3000, 100_000])
    key, a = pitman_yor.mixed(np.arange(6, dtype=np.uint64)), np.array([0.1, 3.0, 0.01, 2.0, 50.0, 4.0])
    sizes, seats = pitman_yor.seated(n, a, 0.7, key)
    of = lambda sizes, seats: [int(s.sum()) for s in np.split(sizes, np.cumsum(seats)[:-1])]
    assert of(sizes, seats) == n.tolist() and (sizes > 0).all() and seats[0] == 1
    for want in (n[::-1].clip(max=4000), n.clip(max=3500)):
        sizes, seats = pitman_yor.reseated(sizes, seats, want, a, 0.7, key) if (want == n).all() else pitman_yor.reseated(*pitman_yor.seated(n.clip(max=3500), a, 0.7, key), want, a, 0.7, key)
        assert of(sizes, seats) == want.tolist() and (sizes > 0).all()


def test_model_counts_chunks_with_one_numbering_and_free_bits():
    chunk = pitman_yor.Chunk()
    chunk.add(b"a b a")
    first = chunk.read()[0]
    chunk.clear()
    chunk.add(b"c a")
    hashes, number, _, text = chunk.read()
    assert (hashes[: len(first)] == first).all() and len(hashes) == len(first) + 1
    assert not (hashes & pitman_yor.KINDS).any() and list(text) == [0, 0, 0]
    assert list(hashes[number.astype(np.int64)][1:]) == [first[2], first[1]]  # a, end; start, end, a, b were numbered


def test_model_lets_many_customers_leave_together():
    """As one after another: tables in proportion, none empty, none in between."""
    dishes, draws = 2000, uniform_draws(2000)
    m = np.tile(np.array([60, 30, 9, 1], np.int64), (dishes, 1))
    t, n = np.full(dishes, 4), np.full(dishes, 100)
    pitman_yor._leave_many(m, t, n, np.arange(dishes), np.full(dishes, 50), draws)
    assert (n == 50).all() and (m.sum(1) == 50).all() and ((m > 0).sum(1) == t).all()
    assert ((np.arange(4) < t[:, None]) == (m > 0)).all()
    assert abs(m[:, 0].mean() - 30) < 0.3 and abs((t == 3).mean() - 0.5) < 0.05


def uniform_draws(n: int) -> np.ndarray:
    return pitman_yor.mixed(np.arange(n, dtype=np.uint64))


def test_model_numbers_words_as_a_plain_reader_does():
    """Words at every length about eight bytes and the long ones, texts that touch, bytes that only look like white space."""
    odd = [b"", b"a", None, b" \t\n\v\f\r", b"b", b"b", b"A\x00 a\x00\x00 a \xc3\x84 \x85c\x1cd \xa0", b"\n".join(b"xy" * k + b" " + b"z" * k for k in (1, 3, 4, 5, 8, 9, 31, 32, 33, 150)), b"end ", b" start"]
    chunk, numbers = pitman_yor.Chunk(), {b"": 0, b" ": 1}
    for texts in (odd[:6], odd[4:], odd):
        for t in texts:
            chunk.add(t)
        hashes, number, contexts, text = chunk.read()
        chunk.clear()
        want = [(numbers.setdefault(w, len(numbers)), i) for i, t in enumerate(texts) for w in ((t or b"").lower().split() + [b" "])]
        assert list(zip(number.tolist(), text.tolist())) == want
        assert hashes.tolist() == [pitman_yor.xxhash.xxh64_intdigest(w, 13) & ~3 for w in numbers]
        before = [0 if k == 0 or want[k - 1][1] != i else want[k - 1][0] for k, (_, i) in enumerate(want)]
        assert contexts.tolist() == [int(hashes[k]) >> 48 for k in before]


def shuffled_rows(df) -> list[int]:
    """Rows written at each exchange of a query that has run."""
    found, plans = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
    while plans:
        plan = plans.pop()
        if "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        if plan.nodeName() == "Exchange":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_model_sends_a_row_a_bucket_and_not_a_word(spark, monkeypatch):
    """Hundreds of words in a few rows; buckets that come in many rows and pieces are summed whole."""
    texts = [" ".join(f"w{i * 7 % 40}x{k * k % (90 + i)}" for k in range(60)) + " the cat" * i for i in range(24)]
    docs = spark.createDataFrame([(i % 3 > 0, t) for i, t in enumerate(texts)], "train boolean, text string").repartition(3)
    want = collections.Counter()
    for i, t in enumerate(texts):
        chunk = pitman_yor.Chunk()
        chunk.add(t.encode())
        hashes, number, contexts, _ = chunk.read()
        for w, u in zip(hashes[number.astype(np.int64)].tolist(), contexts.tolist()):
            want[w, u] += int(i % 3 > 0)
    monkeypatch.setattr(pitman_yor, "BUCKET_BITS", 3)
    for pieces in (False, True):
        if pieces:
            for name, to in (("CHUNK_TOKENS", 64), ("CHUNK_PAIRS", 20), ("PACKS", 1)):
                monkeypatch.setattr(pitman_yor, name, to)
        counts = pitman_yor.pair_counts(docs)
        found = counts.collect()
        got = {(r["w"] % (1 << 64), u): n for r in found for u, n in zip(np.frombuffer(r["us"], np.uint16).tolist(), np.frombuffer(r["ns"], np.int64).tolist())}
        assert got == dict(want) and len({r["w"] for r in found}) == len(found)
        assert all(r["c"] == np.frombuffer(r["ns"], np.int64).sum() for r in found)
        if not pieces:
            assert max(shuffled_rows(counts)) <= 3 * 8 < len(found)  # a row a task and bucket, and the 24 texts


def test_scores_do_not_depend_on_buckets(spark, monkeypatch):
    texts = [prose(i % 5, 40) + " the cat " * (i % 7) + prose(100 + i, 5) for i in range(30)]
    docs = spark.createDataFrame([(str(i), i % 6 == 0, t) for i, t in enumerate(texts)], "id string, held_out boolean, text string")
    with scratch(spark):
        model = pitman_yor.train(docs.select((~F.col("held_out")).alias("train"), "text"))
        runs = []
        for settings in ({}, {"BUCKET_BITS": 2, "PACKS": 1, "CHUNK_TOKENS": 64, "HELD": 5, "HOT": 50}, {"BUCKET_BITS": 1, "BUCKET_PAIRS": 10, "PACKS": 3, "HELD": 0}):
            for name, to in settings.items():
                monkeypatch.setattr(pitman_yor, name, to)
            runs.append({r["id"]: r for r in pitman_yor.scores(docs, model).collect()})
        for run in runs[1:]:
            assert len(run) == 30 and all(run[i]["tokens"] == r["tokens"] and run[i]["known"] == r["known"] for i, r in runs[0].items())
            assert all((run[i]["base"], run[i]["score"]) == pytest.approx((r["base"], r["score"]), rel=1e-6) for i, r in runs[0].items())


def test_model_finds_pairs_as_a_search_does():
    """All that are there and no others, among none, one, many and close ones."""
    many = pitman_yor.mixed(np.arange(3000, dtype=np.uint64))
    close = np.arange(50, dtype=np.uint64) * np.uint64(2) + np.uint64(1 << 63)
    for numbers in (many[:0], many[:1], many, np.append(close, many), np.array([0, (1 << 64) - 1], np.uint64)):
        numbers = np.sort(numbers)
        wanted = np.concatenate([many[::-1], close, close + np.uint64(1), numbers, np.array([0, 1, (1 << 64) - 1], np.uint64)])
        there, at = pitman_yor.Sorted(numbers).find(wanted)
        assert (there == np.isin(wanted, numbers)).all() and (numbers[at] == wanted[there]).all()
