"""Fingerprints: exact neighbours, sketches against full sets, merging, odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscope.llm import fingerprints as fp
from rollscope.llm.minhash import shingles, split_words

SCHEMA = "doc_id long, text string, range int, tail boolean, a long, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, True, 1, "clash") for i, t in rows], SCHEMA)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)] + ["été", "straße"]
    return [" ".join(rng.choice(words, int(rng.integers(0, 400)))) for _ in range(n)]


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = (fp.Sketch.of(x) for x in (t, edited, nxt))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c))
    return out


@pytest.mark.parametrize("range_bytes", [1 << 30, 4000, 300])
def test_neighbours_in_ranges_of_any_size(spark, range_bytes):
    rows = [(int(i) * 3 - 50, t) for i, t in enumerate(texts(80))] + [(1000, "long " * 30_000), (1001, ""), (1002, "x"), (1003, "𝒳é")]
    got = fp.compare_neighbours(frame(spark, rows).repartition(5), range_bytes)
    assert got.columns == fp._OUT.names
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got.collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("range_bytes", [1 << 30, 200])
def test_null_ids_repeats_and_hot_ids(spark, range_bytes):
    hot = [(7, f"document number {k} of the same id " * 4) for k in range(40)]
    rows = hot + [(None, "no id"), (None, None), (8, "twice"), (8, "twice"), (8, "twice"), (-(1 << 63), "lowest")]
    out = fp.compare_neighbours(frame(spark, rows), range_bytes).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    assert sum(r.near_next == 1.0 and r.doc_id == 8 for r in out) >= 2  # two of three equal rows stand before an equal one
    shas = {r.edited_sha256 for r in out if r.doc_id == 7}
    assert len(shas) == len(hot)


def test_single_and_empty(spark):
    (one,) = fp.compare_neighbours(frame(spark, [(3, "one two three four five six")])).collect()
    half = len("one two three four five six") // 2
    text = "one two three four five six"
    assert one.near_next == 1.0
    assert one.edited_sha256 == hashlib.sha256((text[:-half] + text[:half]).encode()).hexdigest()
    assert fp.compare_neighbours(frame(spark, [(3, "x")]).where("false")).count() == 0
    (none,) = fp.compare_neighbours(frame(spark, [(3, None)])).collect()
    assert (none.n_chars, none.fingerprint, none.near_edited, none.near_next) == (0, "w", 1.0, 1.0)


def test_one_text_shuffle(spark):
    plan = fp.compare_neighbours(frame(spark, [(i, t) for i, t in enumerate(texts(20))]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sketches_keep_everything_below_the_threshold():
    rng = np.random.default_rng(5)
    long = " ".join(f"v{i}" for i in rng.integers(0, 10 ** 9, 30_000))
    full = np.unique(shingles(split_words(long)) & fp._TOP)
    sketch = fp.Sketch.of(long)
    assert sketch.hashes.tolist() == full[full < fp._LIMIT].tolist() and not sketch.whole
    again = fp.Sketch.read(str(sketch))
    assert again.hashes.tolist() == sketch.hashes.tolist() and str(again) == str(sketch)
    short = fp.Sketch.of("a b c d e f")
    assert short.whole and len(short.hashes) == 2 and str(fp.Sketch.read(str(short))) == str(short)


def test_containment_of_very_unequal_documents():
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in rng.integers(0, 10 ** 9, 40_000)]
    big, part = fp.Sketch.of(" ".join(words)), fp.Sketch.of(" ".join(words[5000:9000]))
    assert part.likeness(big) == big.likeness(part) > 0.99 and part.jaccard(big) < 0.15
    half = fp.Sketch.of(" ".join(words[8000:9000] + [f"u{i}" for i in range(1000)]))
    assert abs(half.likeness(big) - 0.5) < 0.12
    assert fp.Sketch.of("other words that are nowhere else to be found").likeness(big) == 0


def test_merged_sketch_is_that_of_both():
    rng = np.random.default_rng(8)
    for sizes in ((3, 4), (20, 25), (40, 900), (5000, 6000), (0, 9)):
        a, b = (" ".join(f"v{i}" for i in rng.integers(0, 10 ** 9, n)) for n in sizes)
        both = fp.Sketch(np.unique(np.r_[shingles(split_words(a)), shingles(split_words(b))] & fp._TOP))
        merged = fp.Sketch.of(a).merged(fp.Sketch.of(b))
        assert merged.hashes.tolist() == both.hashes.tolist()


def test_columns(spark):
    df = frame(spark, [(1, "A b  c d e f"), (2, "a B c\td e f"), (3, None), (None, "z")])
    out = fp.fingerprints(df)
    got = {r.doc_id: r.fingerprint for r in out.collect()}
    assert got[1] == got[2] and got[3] == "w" and got[None].startswith("w")
    pairs = out.alias("p").join(out.alias("q"), F.col("p.doc_id") + 1 == F.col("q.doc_id"))
    near = pairs.select("p.doc_id", fp.likeness(F.col("p.fingerprint"), F.col("q.fingerprint")).alias("near"))
    assert {r.doc_id: r.near for r in near.collect()} == {1: 1.0, 2: 0.0}
