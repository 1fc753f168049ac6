"""Logical logs: which rolled files form a log, in which order, at which offsets.

A *file table* has one row per stored file: ``app`` (its directory, i.e. the
application name), ``file_name``, ``path`` and ``length`` (uncompressed bytes).
A *manifest* adds ``pod``, ``file_rank`` and the file's place on the log's
cumulative byte axis, ``file_start`` / ``file_end``.

All of this works on file metadata (one small row per file), never on bytes,
so even a log with millions of rolled files is a modest window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.functions.columns import strip_gz

LOG_KEY = ["app", "pod"]


def file_belongs(file_name, app, pod):
    """A file is part of log (app, pod) if its name starts with the app and holds '-<pod>_'."""
    return file_name.startswith(app) & file_name.contains(F.concat(F.lit("-"), pod, F.lit("_")))


def pods_in_name(file_name: str) -> Column:
    """Every pod a file name names: what stands between any '-' and any later '_'."""
    return F.expr(f"""array_distinct(flatten(transform(split({file_name}, '-'), (x, i) ->
        transform(split(array_join(slice(split({file_name}, '-'), i + 1, length({file_name}) + 1), '-'), '_'), (y, j) ->
            IF(i = 0 OR j = 0, NULL, array_join(slice(split(array_join(slice(
                split({file_name}, '-'), i + 1, length({file_name}) + 1), '-'), '_'), 1, j), '_'))))))""")


def match_files(logs: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the files of each requested log: name starts with the app and contains ``-<pod>_``.

    The pods a file can belong to are cut out of its name, so the join is an equi join on (app, pod)
    for any pod string, and an application with many pods and many rolled files never pairs every
    requested pod with every file.
    """
    keep = [c for c in ("app", "file_name", "path", "length", "modified", "segments", "app_bucket", "read_error")
            if c in files.columns]
    named = files.select(*keep).withColumn("pod", F.explode(pods_in_name("file_name")))
    return (logs.select("app", "pod").join(named, ["app", "pod"])
            .where(F.col("file_name").startswith(F.col("app"))))


def rolled_order(order: str = "name"):
    if order == "name":
        return [strip_gz(F.col("file_name")), F.col("file_name")]
    if order == "modified":
        return [F.col("modified"), F.col("file_name")]
    raise ValueError(f"unknown order {order!r}")


def rolled_sort(files: DataFrame, order: str = "name") -> DataFrame:
    """Files in rolled order: name without '.gz', ties broken by the full name."""
    return files.orderBy(*rolled_order(order))


def with_file_rank(files: DataFrame, order: str = "name") -> DataFrame:
    """Position (1-based) of each file within its log."""
    w = Window.partitionBy(*LOG_KEY).orderBy(*rolled_order(order))
    return files.withColumn("file_rank", F.row_number().over(w))


def with_offsets(ranked: DataFrame) -> DataFrame:
    """Start / end of each file on the cumulative byte axis of its log."""
    w = (Window.partitionBy(*LOG_KEY).orderBy("file_rank")
         .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")
    return (ranked.withColumn("file_start", start)
            .withColumn("file_end", F.col("file_start") + F.col("length").cast("long")))


PART_CHARS = 7   # characters of the rolled suffix that name a part of a log


def rolled_part(order: str = "name", part_chars: int = PART_CHARS) -> Column:
    """The part of its log that a file falls in: a step function of the sort key, so parts follow the rolled order.

    By name, parts are the sort key cut at one length for the whole log: what ``<app>-<pod>_`` takes and
    ``part_chars`` more, so that 10-digit numbers make parts of 1000 files. By time, parts are hours.
    """
    if order == "modified":
        return F.expr("coalesce(unix_seconds(modified) div 3600, -999999999999)")
    width = F.length("app") + F.length("pod") + F.lit(2 + part_chars)
    return F.left(strip_gz(F.col("file_name")), width)


def with_rank_offsets(files: DataFrame, order: str = "name", part_chars: int = PART_CHARS) -> DataFrame:
    """File rank and offsets by a two-level prefix sum, as one log may hold a large share of all files.

    1. rank and sum within (log, part), see ``rolled_part``;
    2. totals per (log, part), combined map-side, prefix-summed over the parts of each log;
    3. join the part offsets back.

    Same result as ``with_file_rank`` + ``with_offsets``, for any names; names decide only how many
    parts there are. The same plan at every size: no job runs to choose it.
    """
    keys = rolled_order(order)
    ranged = files.withColumn("_part", rolled_part(order, part_chars))
    w_local = Window.partitionBy(*LOG_KEY, "_part").orderBy(*keys)
    local = (ranged.withColumn("_lrank", F.row_number().over(w_local))
             .withColumn("_lstart", F.coalesce(
                 F.sum("length").over(w_local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    parts = ranged.groupBy(*LOG_KEY, "_part").agg(F.count(F.lit(1)).alias("_n"),
                                                  F.sum("length").alias("_bytes"))
    w_parts = Window.partitionBy(*LOG_KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*LOG_KEY, "_part",
                         F.coalesce(F.sum("_n").over(w_parts), F.lit(0)).alias("_rank0"),
                         F.coalesce(F.sum("_bytes").over(w_parts), F.lit(0)).alias("_start0"))
    j = local.join(parts, [*LOG_KEY, "_part"])
    return (j.withColumn("file_rank", (F.col("_rank0") + F.col("_lrank")).cast("int"))
            .withColumn("file_start", (F.col("_start0") + F.col("_lstart")).cast("long"))
            .withColumn("file_end", F.col("file_start") + F.col("length").cast("long"))
            .drop("_part", "_lrank", "_lstart", "_rank0", "_start0"))


def total_length(manifest: DataFrame) -> DataFrame:
    """Total bytes of each logical log (0 when no file matches); ``read_error`` where a file table tells it."""
    broken = [F.coalesce(F.bool_or("read_error"), F.lit(False)).alias("read_error")] if "read_error" in manifest.columns else []
    return manifest.groupBy(*LOG_KEY).agg(
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bytes"), *broken)


def build_manifest(logs: DataFrame, files: DataFrame, order: str = "name") -> DataFrame:
    """Match, rank and place the files of every requested log."""
    return with_rank_offsets(match_files(logs, files), order)


def log_directories(files: DataFrame) -> DataFrame:
    """Application directories that exist (hold at least one listed file)."""
    return files.select(F.col("app").alias("dir_app")).distinct()
