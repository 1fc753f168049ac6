"""Helpers shared by the operators: lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage ends here.

    Executors may be lost afterwards: the rows are in files that every node sees.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_small(df: DataFrame, name: str = "llm") -> DataFrame:
    """`cut` for narrow rows that follow a shuffle: at most four files a core, however many shuffle partitions there are.

    A task takes the partitions of its share one after the other. Each file costs a few calls of the store, on a
    local one without Hadoop's native library even new processes, which is more than such a partition's rows cost.
    """
    return cut(df.coalesce(4 * max(1, df.sparkSession.sparkContext.defaultParallelism)), name)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (id, component_id), every node once.

    Alternating large-star / small-star rounds: each node hands its larger (then its smaller)
    neighbours to the smallest node it sees, until the edges are stars around each component's
    smallest id.  Only a row count and a checksum reach the driver; a round is two grouped
    minima (combined map-side) and two equi joins, so a hub with many neighbours is no group
    that one task has to hold.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    edges = cut_small(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = small.union(low.select(F.col("m").alias("a"), "b"))
        edges = cut_small(small.distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
    return nodes.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct())
