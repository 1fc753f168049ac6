"""MinHash near-dedup and embedding near-dedup against brute force on small fixtures."""

import re

import numpy as np
import pytest

from rollscope.llm import embeddings, minhash
from rollscope.llm.common import components

SCHEMA = "doc_id long, text string, component_id string, key int"


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets = [(d, brute_sets(t)) for d, t in docs if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in sets}


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    docs, k = [], 0
    for _ in range(n):
        base = [word() for _ in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 6))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = word()
            docs.append((k, " ".join(w)))
            k += 7
    return docs


@pytest.mark.parametrize("block", [2, 128])
def test_near_duplicates_brute_force(spark, block):
    docs = corpus() + [(5001, "Alpha beta"), (5000, "alpha\tBETA"), (5002, ""), (5003, None), (5004, " \n"),
                       (5005, "one two three four five " * 4000), (5006, "one two three four five " * 4001)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    out = minhash.near_duplicates(df, block=block).collect()
    want = brute(docs)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.n_shingles == len(brute_sets(dict(docs)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in out)


def test_exact_rest_finds_links_hubs_miss(spark):
    """A bucket of several components: only the block comparison joins them."""
    sets = {1: range(0, 100), 2: range(10, 110), 3: range(20, 120), 4: range(500, 600), 5: range(505, 605), 6: range(14, 114)}
    df = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in sets.items()], "id long, shingles array<long>")
    members = spark.createDataFrame([(b, i, c) for b in (8, 9) for i, c in ((1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6))],
                                    "key long, id long, comp long")
    for block in (1, 3, 64):
        edges = minhash._exact_rest(members, df, block).union(spark.createDataFrame([(1, 2)], "a long, b long"))
        got = {r.id: r.component_id for r in components(edges).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4}


def test_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None", "None"]
    empty = minhash.near_duplicates(df.where("false"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 3000):
        assert (minhash.sketch(np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)), 200) < (1 << 63)).all()
    x = np.unique(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    a, b = x[:800], x[100:]  # similarity 700 / 900
    same = (minhash.sketch(a, 2000) == minhash.sketch(b, 2000)).mean()
    assert abs(same - 700 / 900) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (4, 5), (3, 3), (5, 4)], "a long, b long")
    assert {r.id: r.component_id for r in components(edges).collect()} == {9: 1, 8: 1, 7: 1, 1: 1, 4: 4, 5: 4}
    assert components(edges.where("false")).count() == 0


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = rng.normal(size=64)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((k, [float(v) for v in base + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.12, 0.2])], label, "x"))
                k += 1
    rows += [(k, None, 1, "x"), (k + 1, [0.0] * 64, 1, "x"), (k + 2, [float("nan")] + [1.0] * 63, 1, "x"),
             (k + 3, [None] + [1.0] * 63, 1, "x"), (k + 4, [1.0, 0.0], 1, "x"), (k + 5, [2.0, 0.1], 1, "x"), (k + 6, [], 1, "x"),
             (None, [1.0, 0.0], 1, "x"), (k + 4, [1.0, 0.0], 1, "x"), (k + 7, [float("inf")] * 2, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    out = embeddings.near_duplicate_vectors(df, block=16).collect()

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    use = [(i, unit(v), lab) for i, v, lab, _ in rows if i is not None]
    links, root = {i: 0 for i, _, _ in use}, {i: i for i, _, _ in use}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a, (i, x, p) in enumerate(use):
        for j, y, q in use[:a]:
            if x is not None and y is not None and p is not None and p == q and len(x) == len(y) and x @ y >= 0.98:
                pairs += 1
                links[i] += 1 if i != j else 0
                links[j] += 1 if i != j else 0
                root[max(find(i), find(j))] = min(find(i), find(j))
    twice = k + 4  # a repeated row: each of its rows links with the other, and both with the near one
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
    assert len(out) == len(rows)
    assert got[twice] == (2, twice, True) and got[k + 5] == (2, twice, False)
    found = sum(n for i, (n, _, _) in got.items() if i < k)
    assert found >= 0.999 * sum(n for i, n in links.items() if i < k) and pairs > 300
    assert all(n <= links[i] for i, (n, _, _) in got.items() if i < k)
    assert sum(c == find(i) for i, (_, c, _) in got.items()) >= 0.999 * len(got)
    assert all(got[i] == (0, i, True) for i in (k, k + 1, k + 2, k + 3, k + 6, k + 7))
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


def test_rotations_keep_angles():
    x = np.random.default_rng(4).normal(size=(5, 48))
    r = embeddings.rotations(x, 3)
    assert np.allclose(r @ r.T, x @ x.T)


@pytest.mark.parametrize("hashes", sorted(embeddings.SETTINGS))
@pytest.mark.parametrize("cosine", [0.98, 0.985, 0.99])
def test_planted_pairs_share_a_bucket(hashes, cosine):
    rng = np.random.default_rng(hashes)
    x, o = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o -= (o * x).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine ** 2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    salt = np.zeros(1000, np.uint64)
    a, b = (embeddings.bucket_keys(v, salt, hashes) for v in (x, y))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]) >= 0.99


def test_hashes_follow_the_largest_label():
    assert [embeddings.hashes_for(n, 64) for n in (1, 10 ** 6, 10 ** 7, 10 ** 8, 10 ** 12)] == [3, 3, 4, 4, 5]


def test_rounds_of_components_write_few_files(spark):
    """However many shuffle partitions there are, a round's edges go to four files a core at most."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(2000).selectExpr("id * 3 AS a", "id * 3 + 1 AS b")
        found = components(edges.union(edges.selectExpr("b + 1", "a")))
        assert len(found.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism < 64
        assert found.where("component_id != id - id % 3").count() == 0 and found.count() == 6000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
