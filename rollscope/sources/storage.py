"""Where log files are, and which there are: locations and listings that keep every name.

Folders are listed in tasks through pyarrow.  A scheme that pyarrow does not know is first resolved by Hadoop
(a mount table names the storage behind it); where that does not help either, Hadoop itself lists the home.
All three give the same rows: names starting with ``_`` or ``.``, empty files and empty folders too.
"""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.session import reliable_checkpoint, shared_dir

LISTING_SCHEMA = "app string, file_name string, path string, stored_length long, ms long, _top boolean"
LISTING_COLUMNS = ["app", "file_name", "path", "stored_length", "ms", "_top"]
LISTED_AT_ONCE = 50_000  # rows of a Hadoop listing held by the driver
LISTED_IN_TASK = 10_000  # rows of a listing held by a task


class UnknownScheme(ValueError):
    """pyarrow has no file system for the scheme of a location."""


def arrow_location(uri: str):
    """(pyarrow filesystem, path) for a Hadoop-style URI or plain path."""
    import pyarrow as pa
    from pyarrow import fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    try:
        return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        # only these say that there is no such file system here; a refused or failed access is an error
        if re.search(r"Unrecognized filesystem|built without|libhdfs|libjvm", str(e), re.I):
            raise UnknownScheme(f"{uri.split(':', 1)[0]}: {e}") from e
        raise


def hadoop_folder(spark: SparkSession, path: str):
    """(file system, path) as the driver's Hadoop sees them."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def literal_path(home: str) -> str:
    """``home`` as a path in which no character is a wildcard."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", home.rstrip("/"))


def qualified(spark: SparkSession, home: str) -> str:
    """The home as a qualified URI without trailing slash."""
    fs, hpath = hadoop_folder(spark, home)
    return str(fs.makeQualified(hpath).toString()).rstrip("/")


def readable_home(spark: SparkSession, home: str, opener=None) -> str | None:
    """The home as a location that tasks can open with pyarrow; None where only Hadoop can."""
    opener = opener or arrow_location
    fs, hpath = hadoop_folder(spark, home)
    top = qualified(spark, home)
    try:
        opener(top)
        return top
    except UnknownScheme:
        behind = str(fs.resolvePath(hpath).toString()).rstrip("/") if fs.exists(hpath) else top
    if behind != top:
        try:
            opener(behind)
            return behind
        except UnknownScheme:
            pass
    return None


def infos_of(place: str, allow_not_found: bool = False) -> Iterator[tuple]:
    """(name, file?, size, ms) of everything standing in a folder, one by one."""
    from pyarrow import fs as pafs
    fs, p = arrow_location(place)
    if not isinstance(fs, pafs.LocalFileSystem):
        for e in fs.get_file_info(pafs.FileSelector(p, allow_not_found=allow_not_found)):
            yield e.base_name, e.is_file, e.size or 0, (e.mtime_ns or 0) // 1_000_000
        return
    try:
        found = os.scandir(p)
    except FileNotFoundError:
        if allow_not_found:
            return
        raise
    with found:  # pyarrow would hold the whole folder
        for e in found:
            try:
                info = e.stat()
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                yield e.name, False, 0, 0
                continue
            is_file = stat.S_ISREG(info.st_mode)
            yield e.name, is_file, info.st_size if is_file else 0, info.st_mtime_ns // 1_000_000


def entries_of(place: str) -> Iterator[tuple]:
    """(name, folder?, size, time) of everything standing in a folder."""
    for name, is_file, size, ms in infos_of(place):
        yield name, not is_file, size, ms


def listed_folder(home: str, name: str, is_dir: bool, size: int, ms: int) -> Iterator[tuple]:
    """Rows of one entry of the home: a folder's files and a row without a name for the folder; or the plain file."""
    path = f"{home}/{name}"
    if not is_dir:
        yield home.rsplit("/", 1)[-1], name, path, size, ms, True
        return
    yield name, None, None, 0, ms, False
    for file_name, is_file, length, changed in infos_of(path, allow_not_found=True):
        if is_file:
            yield name, file_name, f"{path}/{file_name}", length, changed, False


def in_blocks(rows: Iterator[tuple], columns: list[str], most: int = LISTED_IN_TASK):
    """``rows`` as frames of at most ``most`` rows, so that a folder of any size takes a bounded share of memory."""
    import itertools

    import pandas as pd
    while block := list(itertools.islice(rows, most)):
        yield pd.DataFrame(block, columns=columns)


def _home_lister(home: str):
    entries, blocks = entries_of, in_blocks

    def run(batches):
        for pdf in batches:
            for _ in range(len(pdf)):
                yield from blocks(entries(home), ["name", "is_dir", "size", "ms"])
    return run


def _folder_lister(home: str):
    folder, columns, blocks = listed_folder, LISTING_COLUMNS, in_blocks

    def run(batches):
        for pdf in batches:
            rows = (row for name, is_dir, size, ms in zip(pdf["name"], pdf["is_dir"], pdf["size"], pdf["ms"])
                    for row in folder(home, name, is_dir, size, ms))
            yield from blocks(rows, columns)
    return run


def _hadoop_listing(spark: SparkSession, home: str) -> DataFrame:
    """The same rows from Hadoop's own listing, written to the shared folder in blocks as they come."""
    fs, top = hadoop_folder(spark, home)
    out, rows, base = f"{shared_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}", [], qualified(spark, home)

    def flush():
        spark.createDataFrame(rows, LISTING_SCHEMA).coalesce(1).write.mode("append").parquet(out)
        rows.clear()

    def row(app, status, is_top):
        name = str(status.getPath().getName())
        place = f"{base}/{name}" if is_top else f"{base}/{app}/{name}"
        return app, name, place, int(status.getLen()), int(status.getModificationTime()), is_top

    folders = fs.listStatusIterator(top)
    while folders.hasNext():
        entry = folders.next()
        if not entry.isDirectory():
            rows.append(row(base.rsplit("/", 1)[-1], entry, True))
            continue
        app = str(entry.getPath().getName())
        rows.append((app, None, None, 0, int(entry.getModificationTime()), False))
        files = fs.listStatusIterator(entry.getPath())
        while files.hasNext():
            status = files.next()
            if status.isFile():
                rows.append(row(app, status, False))
            if len(rows) >= LISTED_AT_ONCE:
                flush()
    flush()
    return spark.read.schema(LISTING_SCHEMA).parquet(out)


def _listing(spark: SparkSession, home: str) -> DataFrame:
    """One row a file, every name and empty files too; each application folder also has a row without a file name."""
    place = readable_home(spark, home)
    if place is None:
        rows = _hadoop_listing(spark, home)
    else:
        found = spark.range(1, numPartitions=1).mapInPandas(_home_lister(place), "name string, is_dir boolean, size long, ms long")
        rows = found.repartition(spark.sparkContext.defaultParallelism, "name").mapInPandas(_folder_lister(place), LISTING_SCHEMA)
    return as_listing(rows)


def as_listing(rows: DataFrame) -> DataFrame:
    return rows.select("app", "file_name", "path", "stored_length", F.timestamp_millis("ms").alias("modified"), "_top")


def list_home(spark: SparkSession, home: str) -> DataFrame:
    """One listing of ``home``, pinned with a reliable checkpoint.

    Pass it to ``scan_log_files`` / ``log_directories`` / ``refresh_file_table``
    so one request batch lists the storage once.
    """
    return reliable_checkpoint(_listing(spark, home))


def scan_log_files(spark: SparkSession, home: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Every file one level below ``home`` (not the file contents); names are not percent-encoded."""
    lst = snapshot if snapshot is not None else _listing(spark, home)
    return lst.where(~F.col("_top") & F.col("file_name").isNotNull()).drop("_top")


def log_directories(spark: SparkSession, home: str, snapshot: DataFrame | None = None) -> DataFrame:
    """``dir_app, is_dir``: application directories (empty ones too), and plain files standing in home."""
    lst = snapshot if snapshot is not None else _listing(spark, home)
    dirs = lst.where(~F.col("_top")).select(F.col("app").alias("dir_app")).distinct() \
        .withColumn("is_dir", F.lit(True))
    plain = lst.where(F.col("_top")).select(F.col("file_name").alias("dir_app")) \
        .withColumn("is_dir", F.lit(False))
    return dirs.unionByName(plain)
