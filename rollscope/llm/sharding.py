"""Sharding by sampled splitters: near equal bytes per shard.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them.
Equal texts are one group.  Groups larger than a range but no larger than a shard are few: they are
dealt first, the largest to the emptiest shard.  The others fill what room the shards have left, in
the order of the ranges: the exact bytes of every range give each record its place, and the place
gives the shard.  Ranges that turn out overfull, because one text alone exceeds a shard, are
subdivided by a second key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscope.llm.common import cut

SHARDS = 40
RANGES_PER_SHARD = 50   # ranges aimed at; a range holds about 2 % of a shard
SAMPLES_PER_RANGE = 16  # expected sample: SHARDS * RANGES_PER_SHARD * SAMPLES_PER_RANGE = 32,000 keys
OVERHEAD = 16           # bytes counted for a record besides its text


def splitters(keyed: DataFrame, ranges: int, samples_per_range: int) -> list[int]:
    """Range boundaries from a size-weighted sample of (key, tie, size): at most ``ranges - 1``.

    A record enters the sample with probability proportional to its size (1 for the largest),
    decided by a hash, so a retried task draws the same records. The expected sample is
    ``ranges * samples_per_range`` keys whatever the input's size; those go to the driver.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    want = ranges * samples_per_range
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keyed.where(draw < F.col("size") * F.lit(want / total)).select("key")
    keys = np.sort(np.array([r[0] for r in drawn.collect()], np.int64))
    if not len(keys):
        return []
    at = (np.arange(1, ranges) * len(keys)) // ranges
    return [int(k) for k in np.unique(keys[at])]


def deal_groups(groups: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Deal (key, bytes, rows) groups, the largest first, each to the emptiest shard.

    Returns (key, shard, rows of earlier groups in that shard), and the bytes and rows of each shard.
    """
    heap, load, rows, out = [(0, s) for s in range(shards)], [0] * shards, [0] * shards, []
    for key, size, count in sorted(groups, key=lambda g: (-g[1], g[0])):
        _, s = heapq.heappop(heap)
        out.append((key, s, rows[s]))
        load[s] += size
        rows[s] += count
        heapq.heappush(heap, (load[s], s))
    return out, load, rows


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts share a shard, unless all copies of one text are larger than a shard; shards differ from the
    mean by about two ranges (4 % of a shard) where no single record or group is larger than that.

    * Null text: size 16, crc32 0, the key of the empty text. Null doc_ids and repeated rows are placed
      like any other row; ties in the order are broken by doc_id, and equal rows are interchangeable.
    * One text larger than a shard fills one shard beyond the mean; records are never split.
    * An empty table gives no rows; other columns are ignored.
    """
    ranges = shards * RANGES_PER_SHARD
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = cut(rows.withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id())), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # fewer than `ranges` rows, as each holds more than a range
    large = [tuple(r) for r in groups.where((F.col("bytes") * ranges > total) & ((F.col("bytes") * shards <= total) | (F.col("n") == 1))).collect()]
    dealt, load, counts = deal_groups(large, shards)
    chosen = rows.sparkSession.createDataFrame(dealt, "key long, shard int, before long")
    # the room left in each shard, in order: a place below the n-th bound and not below the one before is in shard n
    left = total - sum(load)
    bounds_of_shards = np.cumsum(_levelled(np.array(load, float), left))

    small = rows.join(F.broadcast(chosen.select("key")), "key", "left_anti")
    bounds = np.array(splitters(small, ranges, SAMPLES_PER_RANGE), np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds_of_shards, place.to_numpy(), side="right"), shards - 1).astype(np.int32))

    ranged = small.withColumn("range", range_of("key"))
    # at most `ranges` rows: how many parts each range needs to be no larger than a few ranges
    stats = ranged.groupBy("range").agg(F.sum("size").alias("size"))
    parts = stats.withColumn("parts", F.ceil(F.col("size") * ranges / F.lit(2 * max(left, 1))).cast("int")).select("range", "parts")
    # only a text larger than a shard is cut, by the second key; its rows stand alone
    split = groups.where((F.col("bytes") * shards > total) & (F.col("n") > 1)).select("key", F.lit(True).alias("split"))
    placed = ranged.join(F.broadcast(parts), "range").join(F.broadcast(split), "key", "left")  # fewer than `shards` keys
    by = F.when(F.col("split"), F.col("tie")).otherwise(F.xxhash64("key", F.lit(3)))
    placed = cut(placed.withColumn("part", F.pmod(by, F.col("parts")).cast("int")), "ranges")

    # bytes and rows before each part: ranges bound the parts, as a range is cut in proportion to its bytes
    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = before.select("range", "part", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("range", "part").orderBy("key", "doc_id", "tie")
    same = Window.partitionBy("range", "part", "key").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(F.broadcast(before), ["range", "part"])
    at = at.withColumn("start", F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = at.withColumn("position", F.col("rows_before") + F.row_number().over(own) - 1)
    at = at.withColumn("first", F.when(F.col("split"), F.col("start")).otherwise(F.min("start").over(same)))
    at = cut(at.select("doc_id", "size", "text_crc32", shard_of(F.col("first").cast("double")).alias("shard"), "position"), "shards")
    first = at.groupBy("shard").agg(F.min("position").alias("first"))  # one row a shard
    filled = at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
    # the dealt groups stand before the others of their shard
    behind = rows.sparkSession.createDataFrame(list(enumerate(counts)), "shard int, large long")
    filled = filled.join(F.broadcast(behind), "shard").withColumn("slot", F.col("slot") + F.col("large")).drop("large")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "tie")) - 1
    whole = rows.join(F.broadcast(chosen), "key").select("doc_id", "size", "text_crc32", "shard", (F.col("before") + nth).cast("long").alias("slot"))
    return filled.unionByName(whole).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _levelled(load: np.ndarray, left: float) -> np.ndarray:
    """How much of ``left`` each shard takes so that all end level, or those that are not above the level."""
    order = np.sort(load)
    for n in range(len(order), 0, -1):  # the n emptiest shards share what is left
        level = (left + order[:n].sum()) / n
        if n == len(order) or level <= order[n]:
            if level >= order[n - 1]:
                return np.maximum(level - load, 0)
    return np.full(len(load), left / len(load))


def write_shards(docs: DataFrame, placement: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write the records themselves: one folder a shard, rows in slot order within a file.

    Joined by doc_id, which must be unique for this; a shard is written by several tasks.
    """
    at = placement.select(F.col("doc_id").alias("_at_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(at, docs["doc_id"].eqNullSafe(at["_at_id"])).drop("_at_id")
    spread = F.floor(F.col("_slot") / 100_000) % files_per_shard
    (rows.repartition("_shard", spread).sortWithinPartitions("_shard", "_slot")
     .withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path))
