"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares are raised to an exponent and normalised.  The exponent is bisected (32 at a
time) until the mixture reaches a target entropy, as far as the repetition limit allows.  The
weights are realised as budgeted block permutations: a source's documents form hashed blocks; an
epoch visits the blocks, and the documents within a block, in a keyed order; whole epochs are
taken first, and the last one stops where the source's token budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.llm.common import cut

ENTROPY_SHARE = 0.9   # target entropy as a share of the uniform mixture's
MAX_EPOCHS = 2.0      # no source is repeated more often
BLOCK_ROWS = 4096     # expected documents in a block
SEED = 17
BROADCAST_SOURCES = 50_000  # up to so many sources their table is broadcast; beyond, Spark joins by shuffle
WORD = r"[^\x20\x09-\x0D]+"


def token_measure(text: Column) -> Column:
    """White-space tokens of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _moments(shares: DataFrame, exponents: list[float], scale: float | None) -> list[tuple]:
    """(exponent, entropy, epochs of the most repeated source), one row an exponent."""
    p = F.pow(F.col("p"), F.col("t"))
    rows = shares.where("p > 0").withColumn("t", F.explode(F.array(*map(F.lit, exponents)))).groupBy("t").agg(
        F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("s"), F.max("p").alias("hi"), F.min("p").alias("lo"))
    out = []
    for r in rows.collect():  # one row an exponent
        reps = (r.hi / r.lo) ** (1 - r.t) if scale is None else scale * max(r.lo ** (r.t - 1), r.hi ** (r.t - 1)) / r.z
        out.append((r.t, math.log(r.z) - r.s / r.z, reps))
    return sorted(out)


def find_exponent(shares: DataFrame, entropy_share: float, max_epochs: float, scale: float | None) -> float:
    """The largest exponent in [0, 1] that reaches the entropy, raised until the repetition limit holds.

    ``shares`` has a share ``p`` for each source; ``scale`` is the budget over all tokens (None: as
    large as it takes for every source to be used once). Entropy and repetition fall as the exponent grows.
    """
    sources = shares.where("p > 0").count()
    if sources < 2:
        return 1.0
    want = entropy_share * math.log(sources)
    lo, hi = 0.0, 1.0
    for _ in range(4):  # 32^-4 is about a millionth
        grid = _moments(shares, [lo + (hi - lo) * i / 32 for i in range(33)], scale)
        flat = [t for t, h, _ in grid if h >= want - 1e-12]
        mild = [t for t, _, r in grid if r <= max_epochs + 1e-12]
        # repetition falls with the exponent, so the limit is kept from min(mild) on
        answer = max(max(flat, default=lo), min(mild, default=hi))
        lo, hi = max(lo, answer - (hi - lo) / 32), min(hi, answer + (hi - lo) / 32)
        if answer >= 1.0 and lo >= 1.0:
            return 1.0
    return answer


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, tokens, h): the whole row as a struct, and a hash that orders documents."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       token_measure(F.col("text")).alias("tokens"),
                       F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"))


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(h, blocks)


def _block_order(block: Column, epoch: Column) -> Column:
    return F.xxhash64(block, epoch, F.lit(SEED + 1))


def _row_order(h: Column, epoch: Column) -> Column:
    return F.xxhash64(h, epoch, F.lit(SEED + 2))


def source_plan(narrow: DataFrame, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
                budget: float | None = None) -> DataFrame:
    """One row a source: tokens, rows, blocks, weight, quota, whole epochs and where the last epoch ends.

    ``narrow`` has (source, tokens, h) for each document. A source without tokens has weight 0 and is
    used once. The last epoch ends at (cut_block, cut_row) in the keyed order: one pair a source.
    """
    stats = cut(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    shares = stats.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = find_exponent(shares, entropy_share, max_epochs, None if budget is None else budget / max(total, 1))
    power = F.when(F.col("p") > 0, F.pow("p", F.lit(exponent))).otherwise(0.0)
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    plan = shares.withColumn("weight", power / F.lit(z))
    if budget is None:  # the smallest budget that uses every source at least once
        budget = plan.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    quota = F.col("weight") * F.lit(float(budget))
    epochs = F.when(F.col("tokens") > 0, quota / F.col("tokens")).otherwise(1.0)
    plan = (plan.withColumn("quota", quota).withColumn("whole", F.floor(epochs + 1e-6).cast("long"))
            .withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long")))
    plan = cut(plan.drop("p").withColumn("exponent", F.lit(exponent)), "plan")

    # the last epoch: the block in which the budget ends, then the last row of it that still fits
    rows = _with_plan(narrow, plan).where("rest > 0").select("source", "tokens", "h", "rest", "whole",
                                                             _block(F.col("h"), F.col("blocks")).alias("block"))
    order = _block_order(F.col("block"), F.col("whole"))
    blocks = rows.groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("t"))
    # a window over the blocks of a source: a few thousandths of its rows
    ahead = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    last = (blocks.withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0)))
            .where("before < rest AND before + t >= rest").select("source", "block", order.alias("cut_block"), "before"))
    last = cut(last, "last")
    inside = rows.join(_small(last.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), "s", "b"),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    own = _row_order(F.col("h"), F.col("whole"))
    run = Window.partitionBy("source", "block").orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("o", own).withColumn("sum", F.col("before") + F.sum("tokens").over(run))
    end = inside.where("sum <= rest").groupBy("source").agg(F.max("o").alias("cut_row"))
    ends = (last.select(F.col("source").alias("s1"), "cut_block")
            .join(end.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2")), "left")
            .select("s1", "cut_block", F.coalesce("cut_row", F.lit(-(1 << 63))).alias("cut_row")))
    return cut(plan.join(ends, plan["source"].eqNullSafe(ends["s1"]), "left").drop("s1"), "plan")


def _small(table: DataFrame, *keys: str) -> DataFrame:
    """A table of a row or so a source: broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.select(F.col("source").alias("plan_source"),
                       *(c for c in plan.columns if c in ("blocks", "whole", "rest", "quota", "cut_block", "cut_row")),
                       F.col("tokens").alias("source_tokens"))
    return rows.join(_small(plan, "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row once for every epoch that takes it: epoch, block, block_order, row_order."""
    rows = _with_plan(rows, plan).withColumn("block", _block(F.col("h"), F.col("blocks")))
    b, r = _block_order(F.col("block"), F.col("whole")), _row_order(F.col("h"), F.col("whole"))
    more = F.col("cut_block").isNotNull() & ((b < F.col("cut_block")) | ((b == F.col("cut_block")) & (r <= F.col("cut_row"))))
    n = F.col("whole") + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    return (rows.where("epoch IS NOT NULL").withColumn("block_order", _block_order(F.col("block"), F.col("epoch")))
            .withColumn("row_order", _row_order(F.col("h"), F.col("epoch"))))


def mixture(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
            budget: float | None = None) -> DataFrame:
    """One row for each document and epoch that takes it: doc_id, source, n_tokens, epoch, block, position, progress.

    ``position`` counts from 0 within a source's epoch; ``progress`` in [0, 1) is the share of the source's
    budget used before, so reading by ``progress`` mixes the sources by their weights.

    * Null source: a source of its own. Null or wordless text: no tokens, taken in every whole epoch.
    * Null doc_ids and repeated rows are documents like any other; equal rows share one place in the
      order, and those at the end of the budget are taken or left together.
    * An empty table gives no rows; other columns are ignored; texts are whole.
    """
    narrow = cut(_rows(docs).drop("row"), "mix")
    plan = source_plan(narrow, entropy_share, max_epochs, budget)
    taken = _taken(narrow, plan)
    blocks = taken.groupBy("source", "epoch", "block", "block_order").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("source", "epoch").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("tokens_before"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("row_order", "doc_id")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = taken.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    used = F.col("epoch") * F.col("source_tokens") + F.col("tokens_before") + F.sum("tokens").over(run) - F.col("tokens")
    return rows.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "epoch", "block",
                       (F.col("rows_before") + F.row_number().over(inside) - 1).alias("position"),
                       F.when(F.col("quota") > 0, used / F.col("quota")).otherwise(0.0).alias("progress"))


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
        budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mixture takes it, with the columns of ``docs``.

    Only (source, tokens, hash) is shuffled for the plan; texts stay where they are read.
    """
    narrow = cut(_rows(docs).select("source", "tokens", "h"), "mix")
    plan = source_plan(narrow, entropy_share, max_epochs, budget)
    rows = _rows(docs).drop("tokens")
    return _taken(rows, plan).select("row.*")
