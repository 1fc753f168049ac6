"""The registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.llm import (
    archive,
    collocation,
    embeddings,
    fingerprints,
    language,
    minhash,
    mixing,
    packing,
    pii,
    quality,
    sharding,
    tokens,
    whitening,
)
from rollscope.llm.common import read_table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokens.default_vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(read_table(spark, sf_dir, "labels"))
    rows = quality.judged(read_table(spark, sf_dir, "documents"), trusted)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "score")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.pseudonymise(docs, pii.session_key(spark), spans="spans")
    return rows.withColumn("n_found", F.size("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), tokens.default_vocabulary())


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, by markup, address and text; and every document, by source and text."""
    docs = read_table(spark, sf_dir, "documents")
    langs, table = language.fit(docs)
    items = language.page_items(read_table(spark, sf_dir, "pages")).union(language.document_items(docs))
    rows = language.identify(items, langs, table)
    return rows.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
                       F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
                       "language", "probability", "declared", "host", "text_language")


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_digest(archive.page_archive(read_table(spark, sf_dir, "pages")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whitening.whiten_vectors(read_table(spark, sf_dir, "embeddings"))
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, fit.explained.tolist())).cast("array<double>"), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
                       "whitened", explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read_table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_sampled_sharding, op3_best_fit_packing, op4_quality_rules, op5_pii_pseudonyms,
    op6_token_counts, op7_embedding_dedup, op8_temperature_mixing, op9_language_id, op10_arc_to_warc, op11_embedding_whitening, op12_phrase_collocations, op13_document_fingerprints)}
# the others have no SQL that yields the same rows: see the README, section "What SQL cannot check"
ORACLES: dict[str, str] = {"op12_phrase_collocations": collocation.SQL}
