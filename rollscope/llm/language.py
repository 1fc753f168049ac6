"""Language identification by Bayesian evidence fusion.

log P(language | item) = tempered text likelihood + P(declared markup language | language)
+ host prior.  The text model is a hashed character-trigram multinomial fitted to a bounded sample
of labelled documents.  The declaration table and the host priors come from grouped aggregation
over all items: language counts by host, smoothed towards the host's domain, that towards the
address suffix, that towards all items; an item's own vote is taken out of its prior.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import cut

BUCKETS = 1 << 14
TRAIN_SAMPLE = 20_000   # labelled documents the text model is fitted on, at most (the first by hashed id)
EVIDENCE = 40.0         # trigrams a text counts for at most: neighbouring trigrams are no independent evidence
STRENGTH = 8.0          # votes that a level's parent counts for
AGREE, DIFFER = 8.0, 1.0  # prior counts of a declaration that agrees, or differs
_DROP = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased letters, other runs as one blank."""
    data = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode()
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


def page_text(page: str) -> str:
    return html.unescape(_DROP.sub(" ", page))


def host_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, its domain: the last two labels, its suffix: the last label), null where there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    return (host, ".".join(labels[-2:]), labels[-1]) if host else (None, None, None)


def fit(labelled: DataFrame, sample: int = TRAIN_SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from at most ``sample`` rows of (doc_id, text, lang).

    The driver gets one row a language and used bucket: at most languages * BUCKETS numbers.
    """
    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                mine = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                mine += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(mine[at])],
                                             ["lang", "bucket", "n"])

    # ids first: the sample is picked without moving any text
    ids = (labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")
    got = rows.mapInArrow(counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in got:
        table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def evidence(items: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(kind, id, host, domain, suffix, declared, text_log array) from items (kind, id, body, url, is_markup).

    One pass over the texts, row by row. For markup the declared language is read from the page and the
    host from the address; otherwise ``url`` is taken as the host itself.
    """
    weights = np.ascontiguousarray(table.T)  # bucket -> one row of log probabilities

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hosts, declared, logs = [], [], []
            for body, url, markup in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()):
                text = body.as_py() or ""
                found = None
                if markup:
                    m = _LANG.search(text)
                    found = m.group(1).lower() if m else None
                    text = page_text(text)
                at = trigrams(text)
                score = weights[at].sum(0) * min(1.0, EVIDENCE / len(at)) if len(at) else np.zeros(len(langs))
                logs.append(score.tolist())
                declared.append(found)
                hosts.append(host_of(url) if markup else (url, None, None))
            host, domain, suffix = zip(*hosts) if hosts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(host, pa.string()), pa.array(domain, pa.string()),
                 pa.array(suffix, pa.string()), pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
                ["kind", "id", "host", "domain", "suffix", "declared", "text_log"])

    return items.select("kind", F.col("id").cast("long").alias("id"), "body", "url", "is_markup").mapInArrow(
        batches, "kind string, id long, host string, domain string, suffix string, declared string, text_log array<double>")


def _votes(prefix: str, langs: list[str]) -> list[Column]:
    return [F.sum((F.col("vote") == i).cast("long")).alias(f"{prefix}{i}") for i in range(len(langs))]


def identify(items: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """One row an item: kind, id, language, probability, declared, host, text_language.

    * Null or letterless text: no text evidence, so declaration and host decide.
    * Null address or declaration: that evidence is missing; the next level up takes its place.
    * Null ids and repeated rows are items like any others. Ties go to the first language by name.
    * Without languages (nothing labelled) language and probability are null. Texts are whole.
    """
    if not langs:
        none = F.lit(None).cast("string")
        return items.select("kind", F.col("id").cast("long").alias("id"), none.alias("language"),
                            F.lit(None).cast("double").alias("probability"), none.alias("declared"), none.alias("host"),
                            none.alias("text_language"))
    k = len(langs)
    rows = cut(evidence(items, langs, table), "evidence")
    best = F.array_position("text_log", F.array_max("text_log")).cast("int") - 1
    silent = F.array_max("text_log") == F.array_min("text_log")
    rows = rows.withColumn("vote", F.when(~silent | F.lit(k == 1), best).otherwise(-1))
    # levels: counts by host, domain, suffix and over all; combined map-side, one row a host is shuffled
    joined, levels = rows, [("suffix", "s"), ("domain", "d"), ("host", "h")]
    for level, p in levels:
        counts = rows.where(F.col(level).isNotNull()).groupBy("kind", level).agg(*_votes(p, langs))
        # rows without this level match nothing: dealt by their id, they do not meet on one key
        deal = F.when(F.col(level).isNull(), F.pmod(F.xxhash64("id", "text_log"), F.lit(4096))).otherwise(F.lit(0)).cast("int")
        joined = joined.withColumn("deal", deal).join(counts.withColumn("deal", F.lit(0)), ["kind", level, "deal"], "left").drop("deal")
    everything = cut(rows.groupBy("kind", "declared").agg(*_votes("n", langs)), "declared").collect()  # one row a declared code
    total = [sum(r[f"n{i}"] for r in everything) for i in range(k)]
    prior = [F.lit((t + 1) / (sum(total) + k)) for t in total]
    for _, p in levels:
        own = [F.coalesce(F.col(f"{p}{i}"), F.lit(0)) - F.when(F.col(f"{p}{i}").isNotNull() & (F.col("vote") == i), 1).otherwise(0)
               for i in range(k)]
        size = reduce(lambda a, b: a + b, own)
        prior = [(own[i] + STRENGTH * prior[i]) / (size + STRENGTH) for i in range(k)]
        joined = joined.select("*", *(x.alias(f"prior_{p}{i}") for i, x in enumerate(prior)))
        prior = [F.col(f"prior_{p}{i}") for i in range(k)]
    # declarations: P(declared | language); codes of no known language share one row
    seen: dict[tuple[str, int], int] = {}
    for r in everything:
        if r.declared is not None:
            code = r.declared if r.declared in langs else "other"
            for i in range(k):
                seen[code, i] = seen.get((code, i), 0) + r[f"n{i}"]
    codes = [*langs, "other"]
    code = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")

    def declared(i: int) -> Column:
        count = [seen.get((c, i), 0) + (AGREE if c == langs[i] else DIFFER) for c in codes]
        table_of = F.create_map(*(F.lit(x) for c, n in zip(codes, count) for x in (c, math.log(n / sum(count)))))
        return F.when(F.col("declared").isNull(), 0.0).otherwise(table_of[code])

    post = F.array(*(F.get("text_log", F.lit(i)) + declared(i) + F.log(prior[i]) for i in range(k)))
    joined = joined.select("kind", "id", "declared", "host", "vote", post.alias("post"))
    top = F.array_max("post")
    names = F.array(*map(F.lit, langs))
    z = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return joined.select("kind", "id", F.get(names, F.array_position("post", top).cast("int") - 1).alias("language"),
                         (1.0 / z).alias("probability"), "declared", "host",
                         F.when(F.col("vote") >= 0, F.get(names, F.col("vote"))).alias("text_language"))


def page_items(pages: DataFrame) -> DataFrame:
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"),
                        F.col("url").alias("url"), F.lit(True).alias("is_markup"))


def document_items(docs: DataFrame) -> DataFrame:
    """Plain texts: the source takes the host's place; there is no declaration and no address suffix."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"),
                       F.col("source").alias("url"), F.lit(False).alias("is_markup"))
