"""The queries without SQL, column by column, against brute force over the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import mixing, quality, registry, secrets, toxicity
from tests.llm.test_operators import lower, slow_base, slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def found(spark, name, texts):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name, mod, rest", [("op1_quality", 3, 1), ("op7_toxicity", 5, 0)])
def test_scores(spark, texts, name, mod, rest):
    for i, r in found(spark, name, texts).items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op4(spark, texts):
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    got = found(spark, "op4_simhash", texts)
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in ids] == [(f"{f:016x}", c) for f, c in zip(fps, slow_components(fps, ids))]


def test_op6(spark, texts):
    names = ("assign", "access", "hex")
    for i, r in found(spark, "op6_secrets", texts).items():
        base = slow_base(texts[i])
        joined = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = [s for s in r["spans"].split(",") if s]
        assert [s for s in every if not s.startswith("random")] == joined
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))


def test_op8(spark, texts):
    got = found(spark, "op8_shards", texts)
    slots = {}
    for i, r in got.items():
        data = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_op8_does_not_depend_on_the_cluster(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    one = sorted(map(str, registry.QUERIES["op8_shards"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == sorted(map(str, registry.QUERIES["op8_shards"](spark, SF).collect()))


def test_op9(spark, texts):
    ids = sorted(texts)
    got = found(spark, "op9_minhash", texts)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items())}
    wrong = []
    for k, i in enumerate(ids):
        text, after = texts[i], ids[(k + 1) % len(ids)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[after][:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 256
        wrong.append(r["near_next"] - len(sets[i] & sets[after]) / len(sets[i] | sets[after]))
    assert np.sqrt(np.mean(np.square(wrong))) < 0.06
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


# Slow versions of what the classifiers fit


def test_ftrl_is_per_coordinate():
    draw = np.random.default_rng(2)
    rows = [(np.unique(draw.integers(0, 40, 12)), float(k % 3 == 0)) for k in range(60)]
    z, n = {-1: 0.0}, {-1: 0.0}

    def weight(i):
        l1 = 0.0 if i < 0 else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for x, y in rows:
            own = [-1, *x]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in own:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * w[i]
    at, w, bias = toxicity.ftrl(rows)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert {*at} == {*want} and np.allclose(w, [want[i] for i in at]) and np.isclose(bias, weight(-1))


def test_isotonic_is_the_least_squares_fit():
    draw = np.random.default_rng(3)
    y, n = draw.random(7), draw.integers(1, 4, 7).astype(float)
    x, v = quality.isotonic(np.arange(7.0), y, n)
    slow = [max(min(np.average(y[a : b + 1], weights=n[a : b + 1]) for b in range(k, 7)) for a in range(k + 1)) for k in range(7)]
    # The points are blocks' means: each value of the slow fit is one of a block, in order.
    assert np.allclose(np.unique(np.round(slow, 9)), np.round(v, 9)) and (np.diff(x) > 0).all()


def test_normal_equations_are_those_of_all_rows(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, quality.STATS)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    train = spark.createDataFrame([(a.tolist(), float(b), k % 2) for k, (a, b) in enumerate(zip(x, y))], "x array<float>, y double, part bigint").repartition(5)
    model = quality.fit(train)
    phi = quality.features(model, x.astype(float))
    ridge = np.eye(phi.shape[1]) * quality.RIDGE * len(x)
    ridge[0, 0] = 1e-9
    assert np.allclose(phi @ model["all"], phi @ np.linalg.solve(phi.T @ phi + ridge, phi.T @ y), atol=1e-4)


# Stages


def test_good_stage_is_the_score(spark):
    from tensorloom.llm.common import label_fold

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["id"]: r["score"] for r in quality.score(docs, labels, label_fold(F.col("id"), 3) != 1).collect()}
    kept = sorted(r["doc_id"] for r in corpus_pipeline.good(spark, docs, SF).collect())
    assert kept == sorted(i for i, s in scores.items() if s >= 0.5)


def test_mixed_stage_is_sorted_by_slow_fair_queueing(spark, texts):
    """Copies by finish time up to the budget, as a plain loop: words in order of their virtual finish times."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    order = sorted({*source.values()}, key=lambda s: (s is None, (s or "").encode()))
    words = []
    for k, s in enumerate(order):
        queue = sorted((i for i in texts if source[i] == s), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
        done = 0
        for _ in range(3):
            for i in queue:
                words += [((done + j + 1) / (k % 3 + 1), k, i) for j in range(size[i])]
                done += size[i]
    words.sort()
    taken = dict.fromkeys(texts, 0)
    for _, _, i in words[: sum(size.values())]:
        taken[i] += 1
    got = {r["doc_id"]: r["taken"] for r in mixing.op5_mix(spark, SF).collect()}
    assert sum(got.values()) == sum(taken.values()) and sum(abs(got[i] - taken[i]) for i in got) <= 2 * len(order)
    rows = [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, SF).collect()]
    assert {i: rows.count(i) for i in texts} == {i: got[i] // size[i] if size[i] else 0 for i in texts}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_lower_is_ascii_only():
    assert lower("ÀAé") == "Àaé"
