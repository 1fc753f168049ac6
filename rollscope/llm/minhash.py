"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its distinct 5-word shingles (64-bit hashes; with fewer words the whole
sequence is one shingle).  Fast similarity sketching throws every element into a hashed bin,
round after round, until no bin is empty; round ``i`` only matters where earlier rounds left a
gap, and rounds ``t .. 2t-1`` aim at one bin each, so every coordinate is filled after ``2t``
rounds at most.  Bands of coordinates give bucket keys; every link is confirmed on the full sets.

Groups of copies never meet in one task: equal word sequences are first folded into one class by
a grouped minimum, then each bucket is compared with one hub (linear in the bucket), and only
buckets that still hold several components get exact block-by-block comparison of the pairs
that hub comparisons left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscope.llm.common import components, cut, cut_small

WORDS = 5            # words in a shingle
PERCENT = 75         # link at 100 * |A ∩ B| >= PERCENT * |A ∪ B|
BANDS, ROWS = 40, 5  # a pair at 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5
BLOCK = 128          # members of an open bucket compared at once
_CACHE = 1 << 18     # word hashes a worker remembers
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def split_words(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs without 0x20 and 0x09-0x0D (what bytes.split() cuts at)."""
    return text.encode().lower().split()


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word windows; one for a shorter sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(n, size)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _ODD + w[i:n - width + 1 + i]
    return np.unique(mix64(h))


def sketch(elements: np.ndarray, coordinates: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: ``coordinates`` 64-bit values, all filled."""
    t, n = coordinates, len(elements)
    seeds = mix64((np.arange(2 * t, dtype=np.uint64) + np.uint64(seed)) * _ODD)
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low, empty = np.uint64(0xFFFFFFFF), np.iinfo(np.uint64).max
    step, i = max(1, -(-2 * t // n)), 0
    while i < t and (out == empty).any():
        rounds = np.arange(i, min(t, i + step), dtype=np.uint64)
        r = mix64(elements[None, :] ^ seeds[i:i + len(rounds), None])
        bins = ((r >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (r & low)).ravel())
        i += step
    for b in np.flatnonzero(out == empty):
        r = mix64(elements ^ seeds[t + b]) & low
        out[b] = (np.uint64(t + b) << np.uint64(32)) | r.min()
    return out


def band_keys(coords: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key a band; the band's number is part of the key."""
    m = coords.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix64(h * _ODD + m[:, j])
    return h.view(np.int64)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    for batch in batches:
        digest, count, keys = [], [], []
        for text in batch.column(1):
            words = split_words(text.as_py() or "")
            s = shingles(words)
            digest.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            count.append(len(s))
            keys.append(band_keys(sketch(s, BANDS * ROWS)) if words else none)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digest, pa.binary()), pa.array(count, pa.int64()), _list_array(keys)],
            ["doc_id", "digest", "n_shingles", "keys"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # bounded output batches: a set is as large as its text
            part = batch.slice(start, 256)
            sets = [shingles(split_words(t.as_py() or "")) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _list_array(sets)], ["id", "shingles"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the word sequence, n_shingles, keys); digest null and no keys without words."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketch_batches, "doc_id long, digest binary, n_shingles long, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "a").join(b, "b")
            .where((100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb))
                   & ((100 + PERCENT) * both >= PERCENT * (na + nb)))
            .select("a", "b"))


def _with_components(cand: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the buckets that still hold two components."""
    comp = components(edges)
    marked = (cand.join(comp, "id", "left")
              .select("key", "id", F.coalesce("component_id", "id").alias("comp")))
    is_open = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return cut_small(marked.join(is_open.where("lo < hi").select("key"), "key", "left_semi"), "open")


def link_block(ids: list, comps: list, sets: list[np.ndarray], left: list[bool]) -> list[tuple]:
    """Links of the ``left`` members with the others, across components.

    A pair is skipped only when the two are already connected, so no component is lost.
    """
    root: dict = {c: c for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flag, out = np.zeros(len(codes), np.int64), []
    right = ~np.array(left, bool)
    for i in np.flatnonzero(~right):
        other = np.array([find(c) != find(comps[i]) for c in comps])
        ok = other & right & (100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i]))
        if not ok.any():
            continue
        mine = codes[starts[i]:ends[i]]
        flag[mine] = 1
        shared = np.add.reduceat(flag[codes], starts)
        flag[mine] = 0
        for j in np.flatnonzero(ok & ((100 + PERCENT) * shared >= PERCENT * (sizes + sizes[i]))):
            x, y = find(comps[i]), find(comps[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _block_links(table: pa.Table) -> pa.Table:
    sets = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in table.column("shingles")]
    links = link_block(table.column("id").to_pylist(), table.column("comp").to_pylist(), sets,
                       table.column("is_left").to_pylist())
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _exact_rest(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Every pair across components in the open buckets, compared in blocks of ``block`` members.

    Members of a bucket's largest component need no comparison with one another: the k others
    (left) meet all m members (right). That makes (k / block) * (m / block) groups of about
    2 * block sets, and m + m * k / block rows: in proportion to m while the others are few.
    Buckets with the same members are looked at once.
    """
    shape = members.groupBy("key").agg(
        F.count("*").alias("m"), *(F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)))
    shape = shape.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m")
    largest = (members.join(shape.select("key"), "key", "left_semi").groupBy("key", "comp").agg(F.count("*").alias("n"))
               .groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top")))
    shape = cut_small(shape.join(largest, "key").select(
        "key", F.col("top.comp").alias("top"), F.ceil(F.col("m") / block).cast("int").alias("rights"),
        F.ceil((F.col("m") - F.col("top.n")) / block).cast("int").alias("lefts")), "shape")
    placed = members.join(shape, "key")
    right = placed.select(
        "key", "id", "comp", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("bi"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("rights")).cast("int").alias("bj"), F.lit(False).alias("is_left"))
    left = placed.where(F.col("comp") != F.col("top")).select(
        "key", "id", "comp", F.pmod(F.xxhash64("id", F.lit(2)), F.col("lefts")).cast("int").alias("bi"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("bj"), F.lit(True).alias("is_left"))
    return (right.unionByName(left).join(sets, "id").groupBy("key", "bi", "bj")
            .applyInArrow(_block_links, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    * Null or wordless text: empty set, linked with nothing, its own component.
    * Equal texts and repeated rows: one class; every row gets the class's component. Rows that
      share a doc_id but not the text follow their own text.
    * Null doc_id: takes no part in linking; component_id null, kept true.
    * Very long texts: whole; sets move only for documents that share a bucket with another.
    * Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(sketches(docs), "sketch")
    named = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))  # equal words, equal keys
    # a bucket is dealt to as many parts as it has members, up to 64: the mask says which parts there are
    keyed = classes.select(F.col("rep").alias("id"), F.explode(F.array_distinct("keys")).alias("key")).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("hi"),
                                      F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts")).where("hub < hi")
    shared = shared.select("key", "hub", F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(parts, i) & 1L) = 1L)")).alias("part"))
    cand = cut(keyed.join(shared, ["key", "part"]).select("key", "id", "hub"), "buckets")
    sets = cut(docs.join(cand.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
               .select("doc_id", "text").mapInArrow(_set_batches, "id long, shingles array<long>"), "sets")

    pairs = cand.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    edges = cut(_verified(pairs, sets), "links")
    rest = _with_components(cand, edges)
    if not rest.isEmpty():
        # another hub for every open bucket: a different random member each
        hub = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "comp")).alias("hub"))
        pairs = (rest.join(hub, "key").where(F.col("comp") != F.col("hub.comp"))
                 .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct())
        edges = cut(edges.union(_verified(pairs, sets)), "links")
        rest = _with_components(rest.select("key", "id"), edges)
        edges = cut_small(edges.union(_exact_rest(rest, sets, block)), "links")
    comp = components(edges).select(F.col("id").alias("rep"), F.col("component_id").alias("low"))

    found = classes.join(comp, "rep", "left").select("digest", F.coalesce("low", "rep").alias("low"))
    out = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with the columns of ``docs``.

    Repeated rows of a kept doc_id are one document: one row stays (the first by hashed text).
    Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), row)
    first = Window.partitionBy("id").orderBy("h", F.hash("row"))
    one = (rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
           .withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*"))
    return one.union(docs.where("doc_id IS NULL"))
