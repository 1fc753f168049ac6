"""Structured Streaming ingestion of rolled log files, from a listing source of our own.

The source (Python Data Source API) yields metadata only: one row a file, every name, and a row for each
folder.  Its offset is the state of a listing: when the home was listed, and the folder names that cut it into
ranges; a partition is one such range, so a replayed batch is planned with the same ranges.  Tasks list the
folders of their range.

``foreachBatch`` hands the listing to ``refresh_file_table``, which finds what is new, grown, changed or gone:
so the streamed table is that of the batch path, growing files included, and a batch that is replayed after a
failure changes nothing twice.  Ranks, offsets and totals of the touched logs are written beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rollscope.operators import manifest as mf
from rollscope.sources import files as fl
from rollscope.sources import filetable as ft
from rollscope.sources import storage as st

SOURCE = "rolled_log_listing"
RANGES = 64  # ranges of folder names listed at once, at most


class NameRange(InputPartition):
    """Names from ``first`` (None: from the beginning) to before ``last`` (None: to the end)."""

    def __init__(self, first: str | None, last: str | None):
        self.first, self.last = first, last

    def holds(self, name: str) -> bool:
        return (self.first is None or name >= self.first) and (self.last is None or name < self.last)


def name_cuts(names: list[str], ranges: int) -> list[str]:
    """Names that cut ``names`` into at most ``ranges`` ranges of about equal counts."""
    names = sorted(set(names))
    return sorted({names[i * len(names) // ranges] for i in range(1, ranges)}) if names else []


class ListingReader(DataSourceStreamReader):
    def __init__(self, home: str, ranges: int):
        self.home, self.ranges = home, ranges

    def initialOffset(self) -> dict:
        return {"listed_ns": 0, "cuts": []}

    def latestOffset(self) -> dict:
        import time
        return {"listed_ns": time.time_ns(), "cuts": name_cuts([e[0] for e in st.entries_of(self.home)], self.ranges)}

    def partitions(self, start: dict, end: dict) -> list[NameRange]:
        cuts = [None, *end["cuts"], None]
        return [NameRange(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: NameRange):
        for entry in st.entries_of(self.home):
            if partition.holds(entry[0]):
                yield from st.listed_folder(self.home, *entry)

    def commit(self, end: dict) -> None:
        """Nothing is held back for committed listings."""


class ListingSource(DataSource):
    """``spark.readStream.format("rolled_log_listing").option("home", ...)``; ``home`` as pyarrow opens it."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return st.LISTING_SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["home"], int(self.options.get("ranges", RANGES)))


def _touched_logs(delta: DataFrame) -> DataFrame:
    return (delta.select("app", "file_name", F.explode(mf.pods_in_name("file_name")).alias("pod"))
            .where(F.col("file_name").startswith(F.col("app"))).select("app", "pod").distinct())


def touched_offsets(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Ranks and offsets (`manifest.build_manifest`) of the logs whose files the newest refresh changed."""
    delta, files = ft.read_delta(spark, table_path), ft.read_file_table(spark, table_path)
    if delta is None:
        return None
    return mf.build_manifest(_touched_logs(delta), files).select("app", "pod", "file_name", "path", "file_rank", "file_start", "file_end")


def write_totals(spark: SparkSession, table_path: str, out: str) -> int | None:
    """Total bytes of the logs that changed since the last call, as ``<out>/totals/seq=<delta>``; returns the number.

    One row a log (app, pod, total_bytes; 0 for a log that is gone). Deltas are taken until their totals are
    complete, so a call that died is made up for by the next one.
    """
    done = max(ft._whole(spark, out, "totals"), default=0)
    fresh = [n for n in ft._whole(spark, table_path, "delta") if n > done]
    if not fresh:
        return None
    logs = _touched_logs(ft._read(spark, table_path, "delta", fresh))
    totals = mf.total_length(mf.build_manifest(logs, ft.read_file_table(spark, table_path)))
    rows = logs.join(totals.select("app", "pod", "total_bytes"), ["app", "pod"], "left").withColumn(
        "total_bytes", F.coalesce("total_bytes", F.lit(0)).cast("long"))
    rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/totals/seq={fresh[-1]}")
    return fresh[-1]


def _batch_writer(home: str, out: str, chunk_bytes: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        listing = fl.reliable_checkpoint(st.as_listing(batch))  # listed once
        before = ft._whole(spark, f"{out}/files", "delta")
        fl.refresh_file_table(spark, home, f"{out}/files", f"{out}/chunks", chunk_bytes, snapshot=listing)
        if ft._whole(spark, f"{out}/files", "delta") != before:
            touched_offsets(spark, f"{out}/files").write.mode("overwrite").parquet(f"{out}/offsets/batch_id={batch_id}")
        write_totals(spark, f"{out}/files", out)

    return write


def stream_rolled_files(spark: SparkSession, home: str, out: str, checkpoint: str,
                        chunk_bytes: int = 1 << 16, available_now: bool = True,
                        processing_time: str | None = None, ranges: int = RANGES):
    """Start (and with ``available_now`` run to completion) the ingestion query.

    Each trigger lists the home once; files are taken whatever their names and age, and grown files are read
    on from their known end.
    """
    place = st.readable_home(spark, home)
    if place is None:
        raise st.UnknownScheme(f"{home}: no listing in tasks for this storage; refresh its file table in batches")
    spark.dataSource.register(ListingSource)
    src = spark.readStream.format(SOURCE).option("home", place).option("ranges", str(ranges)).load()
    w = (src.writeStream.foreachBatch(_batch_writer(home, out, chunk_bytes))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def ingested_files(spark: SparkSession, out: str) -> DataFrame:
    """The file table built so far."""
    return fl.read_file_table(spark, f"{out}/files")


def ingested_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of all batches, with the batch that wrote them, as the batch path's chunk table has them."""
    return fl.read_chunks(spark, f"{out}/chunks")


def ingested_offsets(spark: SparkSession, out: str) -> DataFrame:
    """Ranks and offsets of the logs that each batch touched."""
    return spark.read.parquet(f"{out}/offsets")
