"""Best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut).  Full
pieces fill a sequence alone.  The others are dealt into random groups of a few thousand pieces;
a task packs one group: best fit by descending length, then local search that moves single
pieces, or exchanges one for one and two for one, between underfull sequences so that the sum of
squared fills grows, until the emptiest sequences are empty.  Sequences a group leaves open are
packed again, with those of other groups, in the next and smaller round; a round that closes few
of its pieces is the last, since another one would do no better.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import cut
from rollscope.llm.tokens import table

CAPACITY = 4096
GROUP = 8192       # pieces packed together in one task (expected number)
OPEN = 0.02        # a sequence with more than this share free is open: packed again in the next round
AGAIN = 0.1        # a round that closes less than this share of its pieces is the last: what it left open stays as packed
SEARCH = 20_000    # exchanges tried in one group; what is left is a valid packing all the same


def _digest_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        crc = [zlib.crc32(x.as_buffer()) for x in part.column(4)]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(crc, pa.int64())],
                                         ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): each document's ids, then ``end_id``, cut at ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers. Null text is empty: one piece with the end id.
    ``digest``: ids_crc32 instead of ids, made in the same Python worker; a second worker for each
    running task would hold its own libraries and caches for as long as the executor lives.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = table(vocabulary), end_id.to_bytes(4, "little")
        for part in parts:
            for begin in range(0, part.num_rows, 2048):
                some = part.slice(begin, 2048)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), t.all_ids(some.column(1))):
                    ids += end
                    rows += [(doc, k, k * capacity, ids[o:o + 4 * capacity])
                             for k, o in enumerate(range(0, len(ids), 4 * capacity))]
                doc, k, start, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if digest:
        return rows.mapInArrow(lambda parts: _digest_batches(batches(parts)),
                               "doc_id long, piece int, start long, length long, ids_crc32 long")
    return rows.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: some bin has f free
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(int(i))
        else:
            free, b = capacity, len(bins)
            bins.append([int(i)])
        free -= n
        by_free[free].append(b)
        mask |= 1 << free
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, steps: int = SEARCH) -> list[list[int]]:
    """Move, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    Pieces leave the emptiest bin for fuller ones; what a fuller bin gives back is smaller than
    what it takes.  Ends when nothing improves, when no packing can have fewer bins, or after
    ``steps`` exchanges.
    """
    least = -(-int(lengths.sum()) // capacity)
    fill = np.array([int(lengths[b].sum()) for b in bins])
    home = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    used = int((fill > 0).sum())
    stuck = np.zeros(len(bins), bool)
    while used > least and steps > 0:
        under = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if len(under) < 1:
            break
        low = under[np.argmin(fill[under])]
        steps -= 1
        targets = (fill >= fill[low]) & (fill < capacity)
        targets[low] = False
        free = np.where(targets, capacity - fill, -1)
        items = np.flatnonzero(free[home] >= 0)      # pieces of the other underfull bins
        room = free[home[items]]
        mine = sorted(bins[low], key=lambda i: -lengths[i])
        best = (0, None)
        for x, i in enumerate(mine):
            n = int(lengths[i])
            fits = np.flatnonzero(free >= n)          # a move
            if len(fits):
                k = fits[np.argmin(free[fits])]
                best = (capacity + 1, ((i,), None, int(k)))
                break
            for pair in ((i,), *((i, j) for j in mine[x + 1:])):
                gain = int(lengths[list(pair)].sum()) - lengths[items]
                ok = np.flatnonzero((gain > 0) & (gain <= room))
                if len(ok):
                    j = ok[np.argmax(gain[ok])]
                    if gain[j] > best[0]:
                        best = (int(gain[j]), (pair, int(items[j]), int(home[items[j]])))
        if best[1] is None:
            stuck[low] = True
            continue
        stuck[:] = False
        give, take, k = best[1]
        for i in give:
            bins[low].remove(i)
            bins[k].append(i)
            home[i] = k
        moved = int(lengths[list(give)].sum())
        if take is not None:
            bins[k].remove(take)
            bins[low].append(take)
            home[take] = low
            moved -= int(lengths[take])
        fill[low] -= moved
        fill[k] += moved
        if not bins[low]:
            used -= 1
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin, free of the bin) for each length."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    bin_of, offset, free = (np.empty(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        ends = np.cumsum(lengths[b])
        bin_of[b], offset[b], free[b] = k, ends - lengths[b], capacity - ends[-1]
    return bin_of, offset, free


def place(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid long, unique; length 1..capacity)."""
    full = pieces.where(F.col("length") == capacity).select(
        "uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    done, round_no, first, count = [full], 0, 0, rest.count()
    while count:
        groups = max(1, -(-count // group))

        def packed(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["length", "uid"], ignore_index=True)  # same result on a retry
            b, offset, free = pack_group(part["length"].to_numpy(), capacity)
            return pd.DataFrame({"uid": part["uid"], "length": part["length"], "g": part["g"], "bin": b,
                                 "offset": offset, "free": free})

        dealt = rest.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)))
        result = cut(dealt.groupBy("g").applyInPandas(
            packed, "uid long, length long, g long, bin long, offset long, free long"), "packed")
        left = result.where(F.col("free") > OPEN * capacity)
        width, n_left = result.agg(F.max("bin") + 1, F.count_if(F.col("free") > OPEN * capacity)).first()
        n_left = n_left if groups > 1 else 0
        again = 0 < n_left <= (1 - AGAIN) * count  # so the rounds are few: the pieces shrink by a factor
        closed = result.where(F.col("free") <= OPEN * capacity) if again else result
        # each round numbers its sequences behind those of the rounds before
        number = F.col("g") * width + F.col("bin") + first
        done.append(closed.select("uid", number.alias("sequence_id"), "offset"))
        first += groups * width
        rest, count, round_no = left.select("uid", "length"), n_left if again else 0, round_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * Null text is empty: a piece with the end id alone. Null doc_ids stay null and are packed.
    * Repeated rows are documents of their own: each is packed, with the same doc_id and piece.
    * Ties in length are broken by an internal number, so that a retried task gives the same rows.
    * Texts are whole, however long; other columns are ignored; an empty table gives no rows.
    """
    pieces = token_pieces(docs, vocabulary, capacity=capacity, digest=True)
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(place(pieces, capacity, group), "uid").drop("uid")


def sequences(docs: DataFrame, placement: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids binary): the packed sequences themselves, at most ``capacity`` ids each.

    ``placement`` comes from `pack_documents`; the documents are encoded again and joined by
    (doc_id, piece), which must be unique for this.
    """
    ids = token_pieces(docs, vocabulary, capacity=capacity).select("doc_id", "piece", "ids")
    parts = ids.join(placement.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    packed = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return packed.select("sequence_id", F.expr("aggregate(parts, binary(''), (a, p) -> a || p.ids)").alias("ids"))
