"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A pseudo-random rotation is three rounds of random signs and a fast Hadamard transform.  A vector's
hash is the nearest signed axis of its rotation; a table joins a few hashes into a bucket key.
Multiprobe adds the buckets reached by the second-nearest axis where that is closest.  The number
of hashes follows the largest label, so that unlike vectors seldom share a bucket at any size.
Vectors that share a bucket are compared exactly, in blocks, many buckets a batch; only links at or
above the threshold count.  Equal vectors are folded into one class first, so a very common vector
is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import components, cut
from rollscope.llm.minhash import _list_array, mix64

COSINE = 0.98
# hashes a table -> (tables, probes besides the bucket): recall at the threshold stays above 0.99 (see the tests)
SETTINGS = {3: (12, 1), 4: (16, 3), 5: (24, 5)}
BLOCK = 512
BATCH = 4096  # rows of buckets compared by one call
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep norms."""
    n, d = x.shape
    width = 1
    while width < d:
        x = x.reshape(n, d // (2 * width), 2, width)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        width *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotations(x: np.ndarray, seed: int) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def hashes_for(vectors: int, dimensions: int) -> int:
    """Hashes a table for ``vectors`` of one label: enough for two buckets a vector, within the settings."""
    axes = 2 << max(1, (dimensions - 1).bit_length())
    return next((h for h in SETTINGS if axes ** h >= 2 * vectors), max(SETTINGS))


def bucket_keys(x: np.ndarray, salt: np.ndarray, hashes: int = min(SETTINGS)) -> np.ndarray:
    """(rows, tables * (1 + probes)) 64-bit keys of unit vectors; ``salt`` separates labels and dimensions."""
    tables, probes = SETTINGS[hashes]
    rows, out = np.arange(len(x)), []
    for t in range(tables):
        first, second, loss = [], [], []
        for h in range(hashes):
            r = rotations(x, SEED + t * hashes + h)
            size = np.abs(r)
            a = size.argmax(1)
            top = size[rows, a]
            first.append(2 * a + (r[rows, a] < 0))
            size[rows, a] = -1
            b = size.argmax(1)
            second.append(2 * b + (r[rows, b] < 0))
            loss.append(top - size[rows, b])
        first, second, loss = np.array(first), np.array(second), np.array(loss)
        # subsets of hashes moved to their second axis, the cheapest first; subset 0 is the bucket itself
        subsets = np.array([[(s >> h) & 1 for h in range(hashes)] for s in range(1 << hashes)])
        cost = subsets @ (loss ** 2)
        for s in np.argsort(cost, axis=0, kind="stable")[:1 + probes]:
            codes = np.where(subsets[s].T == 1, second, first)
            key = salt ^ np.uint64(t + 1)
            for c in codes:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
            out.append(key)
    return np.array(out).T


def _valid_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, unit vector in double precision and nothing else for each usable vector."""
    for part in parts:
        digest, unit = [], []
        for v, label in zip(part.column(1), part.column(2)):
            x = None
            if v.is_valid and label.is_valid and len(v.values) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x if top > 0 else None
            digest.append(None if x is None else xxhash.xxh3_128_digest(x.tobytes()))
            if x is not None:
                x = x / np.abs(x).max()  # no overflow or underflow in the norm
                x = x / np.sqrt(x @ x)
            unit.append(None if x is None else x.tolist())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digest, pa.binary()),
                                          pa.array(unit, pa.list_(pa.float64()))], ["vec_id", "label", "digest", "unit"])


def _key_batches(hashes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            labels = part.column(1).to_numpy().astype(np.int64).view(np.uint64)
            vectors = [v.values.to_numpy() for v in part.column(2)]
            keys: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                salt = mix64(labels[at] * np.uint64(1_000_003) + np.uint64(d))
                found = bucket_keys(np.array([vectors[i] for i in at]), salt, hashes)
                for i, k in zip(at, found):
                    keys[i] = np.unique(k)
            yield pa.RecordBatch.from_arrays([part.column(0), _list_array(keys)], ["id", "keys"])
    return run


def _block_links(table: pa.Table) -> pa.Table:
    """Links within the blocks of many buckets, each counted in the one bucket that owns it: the smallest key both ends share."""
    key, bi, bj, part, ids, copies = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "part", "id", "copies"))
    units, shared = table.column("unit").combine_chunks(), table.column("keys").combine_chunks()
    order = np.lexsort((bj, bi, key))
    new = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)) + 1
    links = np.zeros(len(ids), np.int64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for run in np.split(order, new):
        if len(run) < 2:
            continue
        x = np.array([units[int(i)].values.to_numpy() for i in run])
        i, j = bi[run[0]], bj[run[0]]
        left, right = np.flatnonzero(part[run] == i), np.flatnonzero(part[run] == j)
        a, b = np.nonzero(x[left] @ x[right].T >= COSINE)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        keys = [set(shared[int(i)].values.to_numpy().tolist()) for i in run]
        mine = np.array([min(keys[p] & keys[q]) == key[run[0]] for p, q in zip(a, b)], bool)
        a, b = run[a[mine]], run[b[mine]]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for p, q in zip(a.tolist(), b.tolist()):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
    at = np.flatnonzero(links > 0)
    return pa.table({"id": ids[at], "links": links[at], "other": ids[[find(i) for i in at]] if len(at) else ids[:0]})


def near_duplicate_vectors(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    * Null label, null or empty vector, null or non-finite component, zero vector: links with nothing.
    * Vectors of different lengths or labels are never compared.
    * Equal vectors link with each other (their cosine is 1); repeated rows count as vectors of their own.
    * Null vec_id: takes no part; n_links 0, component_id null, kept true.
    * Other columns are ignored; an empty table gives no rows.

    A bucket of m classes makes (m / block)^2 block pairs; a call holds some `BATCH` rows and two blocks
    more. Links are counted there, by the one bucket that owns the pair, and never written out as pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                          F.col("label").cast("long").alias("label"))
    rows = cut(rows.mapInArrow(_valid_batches, "vec_id long, label long, digest binary, unit array<double>"), "units")
    usable = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes, "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "vec_id"), ["label", "digest", "vec_id"]).dropDuplicates(["vec_id", "label", "digest"])
    reps = cut(reps.select(F.xxhash64("label", "digest").alias("id"), "label", "unit", "copies"), "vectors")
    largest = reps.groupBy("label", F.size("unit").alias("d")).agg(F.count("*").alias("n"))
    hashes = max((hashes_for(r["n"], r["d"]) for r in largest.groupBy("d").agg(F.max("n").alias("n")).collect()),
                 default=min(SETTINGS))  # one row a vector length
    keyed = reps.select("id", "label", "unit").mapInArrow(_key_batches(hashes), "id long, keys array<long>")
    keyed = cut(keyed.select("id", F.explode("keys").alias("key")), "keys")
    h = F.xxhash64("id")
    shape = keyed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h).alias("h1"),
                                     F.bit_xor(F.xxhash64("id", F.lit(7))).alias("h2")).where("m > 1")
    # buckets with the same members are looked at once
    shape = shape.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m")
    members = cut(keyed.join(shape, "key"), "members")
    own = members.groupBy("id").agg(F.collect_list("key").alias("keys"))  # tables * (1 + probes) at most
    nb = F.ceil(F.col("m") / block).cast("int")
    placed = (members.withColumn("nb", nb).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nb")).cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("key", "id", "part", F.least("part", "with").alias("bi"), F.greatest("part", "with").alias("bj")))
    # a slot holds whole block pairs, a large bucket's in different slots
    slots = max(1, -(-members.count() // BATCH))
    slot = F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(slots)).alias("slot")
    found = cut(placed.join(reps.select("id", "unit", "copies").join(own, "id"), "id").groupBy(slot)
                .applyInArrow(_block_links, "id long, links long, other long"), "links")
    names = classes.select(F.xxhash64("label", "digest").alias("id"), "label", "digest", "rep", "copies")
    edges = (found.select("id", "other").where("id != other").distinct()
             .join(names.select("id", F.col("rep").alias("a")), "id")
             .join(names.select(F.col("id").alias("other"), F.col("rep").alias("b")), "other").select("a", "b"))
    comp = components(edges).select(F.col("id").alias("rep"), "component_id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = (names.join(links, "id", "left").join(comp, "rep", "left")
            .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component_id", "rep").alias("low")))
    out = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(told, ["label", "digest"], "left")
    low = F.coalesce("low", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      low.alias("component_id"), F.col("vec_id").eqNullSafe(low).alias("kept"))
