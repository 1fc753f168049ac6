"""Document fingerprints: threshold-scaled sketches of word shingles, in a printable form.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of very unequal
documents can be compared and merged.  The `LEAST` smallest hashes are kept as well, so that short documents,
which may have no hash below the threshold, are described too (wholly, up to that many shingles).

Neighbours in doc_id order are compared in one ordered pass: texts are dealt once, by ranges of the order,
and the first document of each range is also sent to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import cut
from rollscope.llm.minhash import shingles, split_words

FRACTION = 16             # shingle hashes below 2^64 / FRACTION are kept
LEAST = 32                # the smallest hashes, kept in any case
RANGE_BYTES = 64 << 20    # text of one range of the order
MOST_RANGES = 20_000
SAMPLES_PER_RANGE = 16    # keys sampled to find the ranges' borders
_LIMIT = np.uint64((1 << 64) // FRACTION)
_TOP = np.uint64(0xFFFFFFFFFFFF0000)  # 48 bits of a hash are written


class Sketch:
    """Sorted 48-bit shingle hashes up to ``limit``; ``whole`` if these are all of the document's."""

    def __init__(self, hashes: np.ndarray, whole: bool = True):
        keep = max(int(np.searchsorted(hashes, _LIMIT)), min(LEAST, len(hashes)))
        self.whole = whole and keep == len(hashes)
        self.hashes = hashes[:keep]

    @classmethod
    def of(cls, text: str) -> Sketch:
        return cls(np.unique(shingles(split_words(text)) & _TOP))

    @classmethod
    def read(cls, fingerprint: str) -> Sketch:
        raw = np.frombuffer(base64.b64decode(fingerprint[1:]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        sketch = cls.__new__(cls)
        sketch.hashes, sketch.whole = wide.view(">u8").ravel().astype(np.uint64), fingerprint[0] == "w"
        return sketch

    def __str__(self) -> str:
        """``w`` (whole) or ``p`` (part), then the first six bytes of each hash in base 64."""
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return ("w" if self.whole else "p") + base64.b64encode(raw.tobytes()).decode()

    def limit(self) -> np.uint64:
        """All of the document's hashes up to here are in the sketch."""
        if self.whole:
            return np.uint64(0xFFFFFFFFFFFFFFFF)
        return max(_LIMIT - np.uint64(1), self.hashes[-1]) if len(self.hashes) else _LIMIT - np.uint64(1)

    def shared(self, other: Sketch) -> tuple[int, int, int]:
        """(own hashes, the other's, common ones) in the part of the range that both sketches cover."""
        limit = min(self.limit(), other.limit())
        a, b = (s.hashes[:int(np.searchsorted(s.hashes, limit, side="right"))] for s in (self, other))
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimated containment of the smaller set in the larger one; 1 for two empty sets, 0 where nothing is known."""
        a, b, both = self.shared(other)
        if not min(a, b):
            return float(self.whole and other.whole and a == b)
        return both / min(a, b)

    def jaccard(self, other: Sketch) -> float:
        a, b, both = self.shared(other)
        if not a + b:
            return float(self.whole and other.whole)
        return both / (a + b - both)

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together."""
        limit = min(self.limit(), other.limit())
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both[both <= limit], self.whole and other.whole)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs`` (doc_id, text).

    Null and wordless texts have the fingerprint ``w``; equal texts have equal fingerprints. Fewer than five
    words are one shingle. Null doc_ids and repeated rows are taken like any other row; other columns are ignored.
    """
    @F.pandas_udf("string")
    def sketched(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: str(Sketch.of(t)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), sketched("text").alias("fingerprint"))


def likeness(a, b):
    """Column: estimated containment (0 to 1) of two fingerprint columns."""
    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else Sketch.read(p).likeness(Sketch.read(q)) for p, q in zip(x, y)])

    return alike(a, b)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())])


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, range, tail) in order: each document but the tail of a range meets the one behind it."""
    out, size = [], 0
    current = None  # (doc_id, text, sketch, range)
    for batch in batches:
        for doc_id, text, at, tail in zip(*(batch.column(i) for i in range(4))):
            at, tail = at.as_py(), tail.as_py()
            if tail and (current is None or current[3] != at):
                continue  # further copies of a tail
            text = text.as_py() or ""
            own = Sketch.of(text)
            if current is not None and current[3] == at:
                before, sketch = current[1], current[2]
                edited = edited_text(before, text)
                changed = sketch if edited == before else Sketch.of(edited)
                out.append((current[0], len(before), hashlib.sha256(edited.encode()).hexdigest(), str(sketch), str(changed),
                            sketch.likeness(changed), sketch.likeness(own), sketch.jaccard(changed), sketch.jaccard(own)))
                size += len(out[-1][3]) + len(out[-1][4]) + 200
            current = None if tail else (doc_id.as_py(), text, own, at)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], _OUT)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], _OUT)


def range_finder(borders: list[tuple[int, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The number of sorted ``borders`` at or before each key (a, b)."""
    first = np.array([x for x, _ in borders], np.int64)
    second = np.array([y for _, y in borders], np.int64)

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(first, a, side="left"), np.searchsorted(first, a, side="right")
        out = lo.copy()
        tied = np.flatnonzero(lo < hi)  # keys whose first part is that of a border
        for x in np.unique(a[tied]):
            some = tied[a[tied] == x]
            i, j = lo[some[0]], hi[some[0]]
            out[some] = i + np.searchsorted(second[i:j], b[some], side="right")
        return out
    return find


def _borders(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Borders of about equal bytes, from a size-weighted sample of the keys; the sample is bounded by `ranges`."""
    want = ranges * SAMPLES_PER_RANGE
    total = keys.agg(F.sum("size")).first()[0] or 0
    if ranges < 2 or not total:
        return []
    draw = F.pmod(F.xxhash64("a", "b", F.lit(23)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sorted(tuple(r) for r in keys.where(draw < F.col("size") * F.lit(want / total)).select("a", "b").collect())
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


def compare_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document of ``docs`` (doc_id, text) against its edited text and the next document by falling doc_id.

    Columns as in `_OUT`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (containment of the smaller set of shingles in the larger), jaccard_edited, jaccard_next.

    * Null text: empty. An empty or one-character text is its own edited text.
    * Null doc_ids stand at the end; rows that share a doc_id are ordered by their text's hash, and equal rows
      are interchangeable. After the last document comes the first; a single one is its own next.
    * Very long texts are taken whole; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    lowest = F.lit((1 << 63) - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("a", F.coalesce(F.bitwise_not("doc_id"), lowest)).withColumn("b", F.xxhash64("text"))
    keys = cut(rows.select("a", "b", (F.octet_length("text") + 16).cast("long").alias("size")), "order")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(-(-total // range_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20)))
    find = range_finder(_borders(keys, ranges))

    @F.pandas_udf("int")
    def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(find(a.to_numpy(), b.to_numpy()).astype(np.int32))

    # one row a range: its first key; the range before it gets that document as its tail
    firsts = sorted((r[0], r[1]["a"], r[1]["b"]) for r in keys.groupBy(range_of("a", "b").alias("range"))
                    .agg(F.min(F.struct("a", "b"))).collect())
    tails = {(a, b): firsts[i - 1][0] for i, (_, a, b) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        at = find(a.to_numpy(), b.to_numpy())
        return pd.Series([[r, tails[key]] if key in tails else [r] for r, key in zip(at.tolist(), zip(a, b))])

    placed = rows.select("doc_id", "text", "a", "b", F.posexplode(places("a", "b")).alias("copy", "range"))
    placed = placed.withColumn("tail", F.col("copy") > 0).repartition("range").sortWithinPartitions("range", "tail", "a", "b")
    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in _OUT)
    return placed.select("doc_id", "text", "range", "tail").mapInArrow(_compare_batches, schema)
