"""The file table: log-structured, one delta a refresh, merged when read, compacted now and then.

``<table>/delta/seq=<n>/app_bucket=<b>/``: the files that a refresh found new, grown, changed or gone (a row
with ``gone``); buckets without a change are not written.  ``<table>/base/seq=<n>/``: everything up to delta
``n``.  A folder counts once Spark has marked it ``_SUCCESS``, so a refresh that dies leaves the table as it was.

A file's bytes are in ``segments``: (batch, start) says that the chunks of that ingestion batch hold its
uncompressed bytes from ``start`` on.  A file that only grew gets a further segment with the new bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.functions.columns import GZ_SUFFIX
from rollscope.session import reliable_checkpoint
from rollscope.sources import files as fl
from rollscope.sources.storage import hadoop_folder, list_home, literal_path, scan_log_files

TARGET_FILE_BYTES = 256 << 20
COMPACT_AFTER = 16  # deltas read together before a base is written

SEGMENTS = T.ArrayType(T.StructType([T.StructField("batch", T.StringType()), T.StructField("start", T.LongType())]))
FILE_TABLE_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("stored_length", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("app", T.StringType()),
    T.StructField("segments", SEGMENTS),
    T.StructField("digest", T.BinaryType()),
    T.StructField("read_error", T.BooleanType()),
    T.StructField("app_bucket", T.IntegerType()),
])
COLUMNS = FILE_TABLE_SCHEMA.names
_STORED = T.StructType([*FILE_TABLE_SCHEMA.fields[:-1], T.StructField("gone", T.BooleanType()),
                        T.StructField("seq", T.LongType()), FILE_TABLE_SCHEMA.fields[-1]])


def _whole(spark: SparkSession, table_path: str, kind: str) -> list[int]:
    """Sequence numbers of the complete bases or deltas, oldest first."""
    fs, marks = hadoop_folder(spark, f"{literal_path(table_path)}/{kind}/seq=*/_SUCCESS")
    found = fs.globStatus(marks)
    return sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found or [])


def _entries(spark: SparkSession, table_path: str) -> tuple[int | None, list[int]]:
    """(the newest base, the deltas after it)."""
    base = max(_whole(spark, table_path, "base"), default=None)
    return base, [n for n in _whole(spark, table_path, "delta") if base is None or n > base]


def _read(spark: SparkSession, table_path: str, kind: str, numbers: list[int]) -> DataFrame:
    root = f"{table_path.rstrip('/')}/{kind}"
    return spark.read.schema(_STORED).option("basePath", root).parquet(*(f"{root}/seq={n}" for n in numbers))


def _write(rows: DataFrame, table_path: str, kind: str, number: int) -> None:
    # metadata only (one row per file): one file a bucket
    (rows.repartition("app_bucket").write.mode("overwrite").partitionBy("app_bucket")
     .parquet(f"{table_path.rstrip('/')}/{kind}/seq={number}"))


def read_delta(spark: SparkSession, table_path: str, number: int | None = None) -> DataFrame | None:
    """What one refresh changed (by default the newest): file rows, and ``gone``."""
    numbers = _whole(spark, table_path, "delta")
    return _read(spark, table_path, "delta", [number or numbers[-1]]).drop("seq") if numbers else None


def read_file_table(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The table as of its newest complete delta, None where there is none.

    A reader keeps what it opened: later refreshes add folders and change none.
    """
    base, deltas = _entries(spark, table_path)
    if base is None and not deltas:
        return None
    if not deltas:
        return _read(spark, table_path, "base", [base]).select(*COLUMNS)
    rows = _read(spark, table_path, "delta", deltas)
    if base is not None:
        rows = rows.unionByName(_read(spark, table_path, "base", [base]))
    elif len(deltas) == 1:
        return rows.where("NOT gone").select(*COLUMNS)
    # newest row of each path; combined map-side
    latest = rows.groupBy("app_bucket", "path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "seq")), "seq").alias("r"))
    return latest.select("r.*").where("NOT gone").select(*COLUMNS)


def compact(spark: SparkSession, table_path: str) -> None:
    """Write a base of everything up to the newest delta."""
    _, deltas = _entries(spark, table_path)
    if deltas:
        _write(read_file_table(spark, table_path).withColumn("gone", F.lit(False)), table_path, "base", deltas[-1])


def drop_superseded(spark: SparkSession, table_path: str, chunk_path: str) -> None:
    """Compact, then delete the deltas and bases below the new base, and the chunk batches that no file names.

    Call it when no reader holds an older state.
    """
    compact(spark, table_path)
    table = read_file_table(spark, table_path)
    if table is None:
        return
    named = {r[0] for r in table.select(F.explode("segments.batch")).distinct().collect()}  # one row a refresh
    base, _ = _entries(spark, table_path)
    old = []
    for path in (chunk_path.rstrip("/"), _locator_path(chunk_path)):
        fs, batches = hadoop_folder(spark, f"{literal_path(path)}/batch=*")
        old += [s.getPath() for s in fs.globStatus(batches) or [] if str(s.getPath().getName()).split("=", 1)[1] not in named]
    old += [hadoop_folder(spark, f"{table_path.rstrip('/')}/delta/seq={n}")[1] for n in _whole(spark, table_path, "delta") if n <= base]
    old += [hadoop_folder(spark, f"{table_path.rstrip('/')}/base/seq={n}")[1] for n in _whole(spark, table_path, "base") if n < base]
    for path in old:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _locator_path(chunk_path: str) -> str:
    return f"{chunk_path.rstrip('/')}_at"


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    fs, hpath = hadoop_folder(spark, path)
    return spark.read.parquet(path).withColumnRenamed("batch", "chunk_batch") if fs.exists(hpath) else None


def read_chunks(spark: SparkSession, chunk_path: str) -> DataFrame | None:
    """Chunk table of ``refresh_file_table``: the chunk rows, chunk_batch, app_bucket."""
    return _batches(spark, chunk_path)


def read_locators(spark: SparkSession, chunk_path: str) -> DataFrame | None:
    """Where the chunks are: see ``files.locate_chunks``; with chunk_batch. Give it to ``log_slices`` as ``chunks``."""
    return _batches(spark, _locator_path(chunk_path))


def _batch_token(files: DataFrame) -> str:
    """Deterministic name of an ingestion batch: a hash over the (path, length, mtime) set."""
    h = files.select(F.sum(F.xxhash64("path", "stored_length", "modified").cast("decimal(38,0)"))
                     .alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"r{int(h['h'] or 0) & ((1 << 63) - 1):x}n{h['n']}"


def refresh_file_table(spark: SparkSession, home: str, table_path: str, chunk_path: str,
                       chunk_bytes: int = 1 << 16, buckets: int = fl.CHUNK_BUCKETS,
                       snapshot: DataFrame | None = None, compact_after: int = COMPACT_AFTER) -> DataFrame:
    """Bring the persisted file table, chunk table and chunk locators up to date with the listing.

    Only files whose (path, stored length, modification time) is new are read. A file that is longer than it
    was, and whose known beginning is still the same (by the digest of its ends), is read from its known end;
    any other changed file is another generation and is read whole. Files that vanished get a ``gone`` row.

    Chunks and locators of one refresh go to folders ``batch=<token>``, the token being a hash of the ingested
    file set, written with overwrite: a refresh that failed half way and is run again rewrites the same folders.
    The delta is written last and counts once complete. Slices join on the batches that a file's segments name,
    so superseded chunks are never read. Each file's ``app_bucket`` is recorded, so ``buckets`` may differ
    between refreshes. One refresh of a table runs at a time. Returns the current file table.
    """
    if snapshot is None:
        snapshot = list_home(spark, home)  # list the tree once per refresh
    listing = scan_log_files(spark, home, snapshot)
    known, key = read_file_table(spark, table_path), ["path", "stored_length", "modified"]
    none = {"known": "long", "digest": "binary", "_length": "long", "_segments": SEGMENTS}
    if known is None:
        fresh, gone = listing.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items())), None
    else:
        was = known.where("NOT read_error AND digest IS NOT NULL").select(
            "path", F.col("stored_length").alias("known"), "digest", F.col("length").alias("_length"), F.col("segments").alias("_segments"))
        fresh = listing.join(known.select(*key), key, "left_anti").join(was, "path", "left")
        grew = F.col("known") < F.col("stored_length")
        fresh = fresh.select(*listing.columns, *(F.when(grew, F.col(c)).alias(c) for c in none))
        gone = reliable_checkpoint(known.join(listing.select("path"), "path", "left_anti"))
    fresh = reliable_checkpoint(fresh)  # pin the set being ingested
    if known is not None and fresh.isEmpty() and gone.isEmpty():
        return known  # nothing arrived, changed or vanished
    token = _batch_token(fresh)
    stored = fresh.select(F.sum("stored_length")).first()[0]  # one scalar, NULL when nothing is new
    rows = None
    if stored is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-int(stored) // TARGET_FILE_BYTES))
        batch_dir = f"{chunk_path.rstrip('/')}/batch={token}"
        fl.write_chunks(fl.build_chunks(spark, home, chunk_bytes, fresh, tasks), batch_dir, mode="overwrite", buckets=buckets)
        written = spark.read.schema(T.StructType([*fl.CHUNK_SCHEMA.fields, T.StructField("app_bucket", T.IntegerType())])).parquet(batch_dir)
        fl.locate_chunks(written).write.mode("overwrite").parquet(f"{_locator_path(chunk_path)}/batch={token}")
        sums = fl.chunk_sums(written).withColumnsRenamed({"digest": "_digest", "path": "_path"})
        rows = fresh.join(sums, F.col("path") == F.col("_path"), "left")
        on = F.coalesce("appended", F.lit(False))
        start = F.when(on, F.col("_length")).otherwise(F.lit(0).cast("long"))
        segment = F.array(F.struct(F.lit(token).alias("batch"), start.alias("start")))
        length = (F.when(F.col("file_name").endswith(GZ_SUFFIX), start + F.coalesce("n_bytes", F.lit(0)))
                  .otherwise(F.col("stored_length")))
        rows = rows.select(*listing.columns, length.cast("long").alias("length"),
                           F.when(on, F.concat("_segments", segment)).otherwise(segment).alias("segments"),
                           F.col("_digest").alias("digest"), F.coalesce("read_error", F.lit(False)).alias("read_error"),
                           fl.app_bucket(F.col("app"), buckets).alias("app_bucket"), F.lit(False).alias("gone"))
    if gone is not None:
        lost = gone.withColumn("gone", F.lit(True))
        rows = lost if rows is None else rows.unionByName(lost)
    _write(rows, table_path, "delta", max([*_whole(spark, table_path, "delta"), *_whole(spark, table_path, "base")], default=0) + 1)
    if len(_entries(spark, table_path)[1]) >= compact_after:
        compact(spark, table_path)
    return read_file_table(spark, table_path)
