"""Quality rules: base rules and an n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into a table whose size follows the bytes of the corpus.  A multinomial over
the table is fitted to trusted documents, another to the raw corpus (all documents); a document's score is the
mean over its n-grams of log(p_trusted / p_raw).  Trusted documents fall into two folds, and a trusted document
is scored by the other fold only, so its score is that of a document the target has not seen: the threshold is
a low quantile of these scores.  Every trusted document is fitted on and scored.  The weights of the whole table are looked up within the row: no text, and no
n-gram after counting, is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import cut

LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 22  # n-gram table: 6 bytes a bucket wherever rows are scored
BYTES_PER_BUCKET = 512   # bytes of text a bucket, between these bounds
TASK_BYTES = 256 << 20   # text counted by one task: a task writes one row a bucket at most
STEP = 0.001             # weights are kept in this unit
SMOOTHING = 4.0          # prior count of every bucket, so that one seen once or twice says little
HELD_OUT = 0.005         # quantile of the held-out trusted documents' scores that is the threshold
BROADCAST_IDS = 2_000_000  # trusted ids sent to the executors, counted first; more are joined by shuffle
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r"  # parted by these and the space
NO_SYMBOLS = r"[^#*$%&|<>]+"


def repeated_words(windows: Column) -> Column:
    """Words covered by 5-word windows whose hash occurs twice or more, from the windows' hashes in order."""
    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    # each repeated window covers up to the next one's first word, or its own five words
    starts = F.transform(F.array(paired), covered)[0]
    total = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
                        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
                        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    """The words of ``text`` in order; by plain replacement and splitting, which cost less than a regular expression."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def neighbours(items: str, apart: int) -> Column:
    """Hashes of every item and the one ``apart`` places behind it; the column ``items`` must hold more than that."""
    n = F.size(items) - apart
    return F.zip_with(F.slice(items, 1, n), F.slice(items, 1 + apart, n), lambda a, b: F.xxhash64(a, b))


def gram_rows(docs: DataFrame) -> DataFrame:
    """(row, id, text, n_words, word_chars, windows, grams): the whole input row, hashes of 5-word windows, of words and word pairs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    none = F.array().cast("array<bigint>")

    # from item to item side by side: looking items up by their place would cost more than hashing them
    rows = rows.withColumn("pairs", F.when(n >= 2, neighbours("hashes", 1)).otherwise(none))
    rows = rows.withColumn("triples", F.when(n >= 3, neighbours("pairs", 1)).otherwise(none))
    windows = F.when(n >= 5, neighbours("triples", 2))
    return rows.select("row", "id", "text", n.cast("long").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("long").alias("word_chars"), windows.alias("windows"),
                       F.concat("hashes", "pairs").alias("grams"))


def base_rules(rows: DataFrame) -> DataFrame:
    """(row, id, grams, the counts, base_failed)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.withColumn("lines", lines)
    repeat = F.coalesce(repeated_words(F.col("windows")), F.lit(0).cast("long"))
    rows = rows.select(
        "row", "id", "grams", "n_words", "word_chars",
        F.length(F.regexp_replace("text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents (label quality 1)."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted")).distinct()


def sent(trusted: DataFrame) -> DataFrame:
    """``trusted`` (stored), to be broadcast if it holds at most `BROADCAST_IDS`; no text is shuffled then."""
    return F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted


def marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` with ``fold``: 0 or 1 for a trusted document, else null."""
    folds = trusted.select("trusted", F.pmod(F.xxhash64("trusted", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    return rows.join(sent(folds), F.col("id") == F.col("trusted"), "left").drop("trusted")


def table_size(docs: DataFrame) -> tuple[int, int]:
    """(buckets of the n-gram table, bytes of text): the table grows with the corpus, between fixed bounds."""
    bytes_ = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    wanted = 1 << max(0, math.ceil(bytes_ / BYTES_PER_BUCKET) - 1).bit_length()
    return min(max(wanted, LEAST_BUCKETS), MOST_BUCKETS), bytes_


def bucket(gram: Column, buckets: int) -> Column:
    return gram.bitwiseAND(F.lit(buckets - 1)).cast("int")  # buckets: a power of two


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int, bytes_: int) -> DataFrame:
    """(slot, raw, own0, own1): n-grams of all documents, and of the trusted ones of each fold, in each bucket that has any.

    Combined map-side; tasks are wide, as each writes a row for every bucket it meets.
    """
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    rows = gram_rows(docs.coalesce(max(2 * parallel, -(-bytes_ // TASK_BYTES)))).select("id", "grams")
    # outer: explode() would have Spark push a filter on the computed array down into the expressions that make it
    grams = marked(rows, trusted).select("fold", F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    return cut(grams.groupBy(bucket(F.col("gram"), buckets).alias("slot")).agg(
        F.count("*").alias("raw"), F.count_if(F.col("fold") == 0).alias("own0"), F.count_if(F.col("fold") == 1).alias("own1")), "grams")


def bucket_weights(counts: DataFrame, buckets: int) -> dict[str, DataFrame] | None:
    """w0, w1 (by fold) and mean: one row, the weight log(p_trusted / p_raw) of every bucket in order, in units of `STEP`.

    None without trusted words. Three tables, so that each is sent to the executors once and by itself.
    """
    total = counts.agg(*(F.sum(c).alias(c) for c in ("raw", "own0", "own1"))).first()
    if not total["own0"] and not total["own1"]:
        return None

    def weight(own: str) -> Column:
        if not total[own]:  # a fold without words says nothing
            return F.lit(0.0)
        # both multinomials get the same prior: SMOOTHING raw counts a bucket, and as many in proportion among the trusted
        scale = total["raw"] / total[own]
        return F.log(F.col(own) * F.lit(scale) + SMOOTHING) - F.log(F.col("raw") + F.lit(SMOOTHING))

    # dense arrays in two steps: pieces of 4,096 buckets, then the pieces in order
    piece = 4096
    known = counts.select("slot", weight("own0").alias("w0"), weight("own1").alias("w1"))
    known = known.withColumn("mean", (F.col("w0") + F.col("w1")) / 2)
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
    dense = cut(every.join(known, "slot", "left"), "weights")
    out = {}
    for name in ("w0", "w1", "mean"):
        value = F.coalesce(F.round(F.col(name) / STEP), F.lit(0.0)).cast("short").alias("w")
        pieces = dense.groupBy(F.floor(F.col("slot") / piece).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("slot", value))).alias("c"))
        whole = pieces.agg(F.sort_array(F.collect_list(F.struct("piece", F.col("c.w").alias("w")))).alias("p"))  # buckets / 4096 rows
        out[name] = cut(whole.select(F.flatten("p.w").alias(name)), name)
    return out


def scored(docs: DataFrame, trusted: DataFrame, weights: dict[str, DataFrame] | None, buckets: int) -> DataFrame:
    """``base_rules`` rows with ``fold`` and ``score``: the mean weight of the row's n-grams, 0 without any.

    A trusted document takes the weights of the fold it is not in, any other document the mean of both.
    """
    rows = marked(base_rules(gram_rows(docs)), trusted)
    if weights is None:
        return rows.withColumn("score", F.lit(0.0))

    # each column is named once below: so it stays a reference to one array and is not copied into the rows
    for name, table in weights.items():
        rows = rows.withColumn(name, table.scalar())

    def total(name: str) -> Column:
        return F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(F.col(name), bucket(g, buckets)).cast("long"))

    told = F.when(F.col("fold") == 0, total("w1")).when(F.col("fold") == 1, total("w0")).otherwise(total("mean"))
    rows = rows.withColumn("told", told).drop(*weights)
    return rows.withColumn("score", F.when(F.size("grams") > 0, F.col("told") * STEP / F.size("grams")).otherwise(0.0)).drop("told")


def held_out_threshold(docs: DataFrame, trusted: DataFrame, weights: dict[str, DataFrame] | None, buckets: int,
                       share: float = HELD_OUT) -> float:
    """The ``share`` quantile of the held-out scores of all trusted documents that pass the base rules.

    Exact: of n scores the one of rank ceil(share * n), counted and taken from the lowest ones.
    """
    if weights is None:
        return -math.inf
    mine = docs.join(sent(trusted), F.col("doc_id").cast("long") == F.col("trusted"), "left_semi")
    scores = closed(scored(mine, trusted, weights, buckets).select("base_failed", "score")).where("NOT base_failed")
    scores = cut(scores.select("score"), "held_out")
    rank = math.ceil(share * scores.count())
    return scores.orderBy("score").limit(rank).agg(F.max("score")).first()[0] if rank else -math.inf


def closed(rows: DataFrame) -> DataFrame:
    """``rows`` behind a row number, so that Spark does not push a later condition into, and repeat, their expressions."""
    return rows.withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0").drop("_at")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """``row`` (the whole input row as a struct), the base rules, score and kept; one row for each input row.

    ``threshold``: scores below it are rejected; by default the low quantile of held-out trusted documents.

    * Null text counts as none: no words, base_failed. Null doc_ids are judged like any other row.
    * Repeated rows are judged one by one and equally; very long texts are judged whole.
    * Without trusted documents every score is 0, so the base rules alone decide.
    * Extra columns, whatever their names, stay inside ``row``; an empty table gives no rows.
    """
    trusted = cut(trusted, "trusted")
    buckets, bytes_ = table_size(docs)
    weights = bucket_weights(bucket_counts(docs, trusted, buckets, bytes_), buckets)
    if threshold is None:
        threshold = held_out_threshold(docs, trusted, weights, buckets)
    rows = scored(docs, trusted, weights, buckets).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    return closed(rows).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judged(docs, trusted, threshold).where("kept").select("row.*")
