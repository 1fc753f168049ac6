"""Applications and executors derived from event-log JSON lines; event-log export.

An event log is a folder (or file) of JSON lines, one event per line, one
log per application attempt.  The end event carries no application id, so
every line is keyed by the log it came from (its folder).  Aggregation per
log uses only max / min / bool_or, which Spark combines map-side, so a huge
log never lands whole in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.sources.files import gunzip
from rollscope.sources.storage import arrow_location, hadoop_folder, readable_home

# --- Fixed values: event names and JSON field names of the event-log format ---
EV_APP_START = "SparkListenerApplicationStart"
EV_APP_END = "SparkListenerApplicationEnd"
EV_EXEC_ADDED = "SparkListenerExecutorAdded"
EV_EXEC_REMOVED = "SparkListenerExecutorRemoved"
# -------------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("Event", T.StringType()),
    T.StructField("App Name", T.StringType()),
    T.StructField("App ID", T.StringType()),
    T.StructField("App Attempt ID", T.StringType()),
    T.StructField("User", T.StringType()),
    T.StructField("Timestamp", T.LongType()),
    T.StructField("Executor ID", T.StringType()),
    T.StructField("Removed Reason", T.StringType()),
    T.StructField("Executor Info", T.StructType([
        T.StructField("Host", T.StringType()),
        T.StructField("Total Cores", T.IntegerType()),
        T.StructField("Log Urls", T.MapType(T.StringType(), T.StringType())),
    ])),
])


PARTS = "app_id string, attempt_id string, part string, path string"          # of an export's part files
EXPORTED = "app_id string, attempt_id string, value string, part string, at long"
PART_COLUMNS, LINE_COLUMNS = ([c.split(" ")[0] for c in x.split(", ")] for x in (PARTS, EXPORTED))
PARTS_SUFFIX = "_parts"  # of the folder beside an export that lists its part files
HELD_BYTES = 1 << 20    # of a part file, held before they are packed
LINES_AT_ONCE = 10_000  # of one output frame
LISTED_OUT = 10_000  # superseded files left out of the scan by name; more are joined away


def superseded_files(spark: SparkSession, root: str) -> DataFrame:
    """``file_path`` of the rolled files that a newer compacted file replaces.

    ``events_<n>_<app>.compact`` holds what matters of the files up to n of its log; those may still be there.
    Names only: no line is read.
    """
    files = spark.read.format("binaryFile").load(root.rstrip("/") + "/*").select(F.col("_metadata.file_path").alias("file_path"))
    folder, name = F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1), F.regexp_extract("file_path", r"/([^/]+)$", 1)
    rolled = files.select("file_path", folder.alias("folder"), F.regexp_extract(name, r"^events_(\d+)_", 1).try_cast("int").alias("n"),
                          name.endswith(".compact").alias("compact")).where(
        F.regexp_extract("folder", r"([^/]+)$", 1).rlike("(^|=)eventlog_v2_") & F.col("n").isNotNull())
    newest = rolled.where("compact").groupBy("folder").agg(F.max("n").alias("upto"))
    return rolled.join(newest, "folder").where((F.col("n") < F.col("upto")) | ((F.col("n") == F.col("upto")) & ~F.col("compact"))).select("file_path")


def read_event_lines(spark: SparkSession, root: str) -> DataFrame:
    """``log, value, file_no, block, line``: every line of the event logs below ``root``, its log and place.

    A rolled log is a folder ``eventlog_v2_...`` of files ``events_<n>_...``, of which the newest compacted one
    replaces all up to its number (`superseded_files`); any other file is a log of its own, named by its file
    name without compression suffixes.  Works for plain, gz and zstd files.
    Other sources of (log, value) rows -- e.g. a shipped line table -- can be passed to the parsers too;
    for an ordered export they carry a ``line`` number.
    """
    text, old = spark.read.text(root.rstrip("/") + "/*"), superseded_files(spark, root)
    some = [r[0] for r in old.limit(LISTED_OUT + 1).collect()]
    if len(some) <= LISTED_OUT:  # a condition on the file's name alone keeps the file from being opened
        text = text.where(~F.col("_metadata.file_path").isin(some)) if some else text
    else:
        text = text.withColumn("_path", F.col("_metadata.file_path")).join(old, F.col("_path") == F.col("file_path"), "left_anti")
    lines = text.select(
        F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    folder, name = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"/([^/]+)$", 1)
    rolled = folder.rlike("(^|=)eventlog_v2_")
    single = F.regexp_replace(name, r"(\.(gz|zst|zstd|lz4|lzf|snappy|inprogress))+$", "")
    number = F.coalesce(F.regexp_extract(name, r"^events_(\d+)_", 1).try_cast("int"), F.lit(0))
    return lines.select(F.when(rolled, folder).otherwise(single).alias("log"), "value",
                        F.when(rolled, number).otherwise(0).alias("file_no"), "block", "line")


def _ms_to_ts(col):
    return F.timestamp_millis(col).cast("timestamp_ntz")


def parse_events(lines: DataFrame, by: Sequence[str] = ("log",)) -> DataFrame:
    """Parse the lines of the four events used here; the columns ``by`` are kept.

    Real event logs are dominated by task and stage events; a plain substring
    test (code-generated, no JSON work) drops those lines before ``from_json``.
    """
    wanted = F.lit(False)
    for name in (EV_APP_START, EV_APP_END, EV_EXEC_ADDED, EV_EXEC_REMOVED):
        wanted = wanted | F.col("value").contains(name)
    e = lines.where(wanted).select(*by, F.from_json("value", EVENT_SCHEMA).alias("e"))
    return e.select(*by, "e.*")


def attempts_of(events: DataFrame, by: Sequence[str] = ("log",)) -> DataFrame:
    """One row per log = per attempt: ids, name, start, end (NULL while running); none for a log with neither.

    Maxima of strings are aggregated over sorted rows.  So the few start and end events are dealt by log first:
    they are sorted once, in partitions of bounded size, and not as much of them as a scan's split holds.
    """
    ev = F.col("Event")
    is_start, is_end = ev == EV_APP_START, ev == EV_APP_END
    return events.where(is_start | is_end).repartition(*by).groupBy(*by).agg(
        F.max(F.when(is_start, F.col("App ID"))).alias("id"),
        F.max(F.when(is_start, F.col("App Name"))).alias("name"),
        F.max(F.when(is_start, F.col("App Attempt ID"))).alias("attemptId"),
        F.min(F.when(is_start, F.col("Timestamp"))).alias("start_ms"),
        F.max(F.when(is_end, F.col("Timestamp"))).alias("end_ms"),
        F.coalesce(F.bool_or(is_end), F.lit(False)).alias("completed"))


def executors_added(events: DataFrame, by: Sequence[str] = ("log",)) -> DataFrame:
    """One row per added executor."""
    return events.where(F.col("Event") == EV_EXEC_ADDED).select(
        *by, F.col("Executor ID").alias("id"), F.col("Timestamp").alias("add_ms"), F.col("Executor Info.Host").alias("host"),
        F.col("Executor Info.Total Cores").alias("totalCores"), F.col("Executor Info.Log Urls").alias("executorLogs"))


def executors_removed(events: DataFrame, by: Sequence[str] = ("log",)) -> DataFrame:
    """The last removal of each executor of a log."""
    return events.where(F.col("Event") == EV_EXEC_REMOVED).groupBy(*by, F.col("Executor ID").alias("id")).agg(
        F.max("Timestamp").alias("remove_ms"), F.max("Removed Reason").alias("removeReason"))


def event_logs_to_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications with nested attempts newest first, executors with log URLs)."""
    events = parse_events(lines)
    return tables_of(attempts_of(events), executors_added(events), executors_removed(events))


def tables_of(attempts: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, executors) from rows per log, parsed at once or merged from earlier parses."""
    att = attempts.where(F.col("id").isNotNull())
    # newest first: later start, then the larger attempt id (numeric ids compare by length first)
    a = att.select("id", "name", F.struct(
        _ms_to_ts(F.col("start_ms")).alias("startTime"), F.length("attemptId").alias("_idlen"),
        F.col("attemptId"),
        _ms_to_ts(F.col("end_ms")).alias("endTime"), F.col("completed")).alias("a"))
    apps = a.groupBy("id").agg(
        F.max("name").alias("name"),
        F.sort_array(F.collect_list("a"), asc=False).alias("s"))
    apps = apps.select("id", "name", F.transform("s", lambda x: F.struct(
        x["attemptId"].alias("attemptId"), x["startTime"].alias("startTime"),
        x["endTime"].alias("endTime"), x["completed"].alias("completed"))).alias("attempts"))
    added = added.withColumn("add_ms", _ms_to_ts(F.col("add_ms"))).withColumnRenamed("add_ms", "addTime")
    removed = removed.withColumn("remove_ms", _ms_to_ts(F.col("remove_ms"))).withColumnRenamed("remove_ms", "removeTime")
    execs = (added.join(removed, ["log", "id"], "left")
             .join(att.select("log", F.col("id").alias("app_id"), "attemptId"), "log")
             .withColumn("isActive", F.col("removeTime").isNull()))
    return apps, execs.drop("log")


def partition_value(value: str) -> str:
    """``value`` as it stands in the name of a partition folder."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) or "__HIVE_DEFAULT_PARTITION__"


def _part_writer(out: str):
    opener, escaped, held_bytes = arrow_location, partition_value, HELD_BYTES

    def run(batches):
        import os

        import pandas as pd
        from pyspark import TaskContext

        fs, root = opener(out)
        part, key, stream, held, size = TaskContext.get().partitionId(), None, None, [], 0

        def close():
            stream.write("".join(held).encode())
            stream.close()
            fs.move(tmp, place)
            return *key, name, f"{out}/{folder}/{name}"

        for pdf in batches:
            done = []
            for app, attempt, value in zip(pdf["app_id"], pdf["attempt_id"], pdf["value"]):
                if (app, attempt) != key:
                    if stream is not None:
                        done.append(close())
                    key, held, size = (app, attempt), [], 0
                    folder, name = f"app_id={escaped(app)}/attempt_id={escaped(attempt)}", f"part-{part:05d}.txt.gz"
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    tmp, place = f"{root}/{folder}/.{name}.{os.getpid()}.tmp", f"{root}/{folder}/{name}"
                    stream = fs.open_output_stream(tmp, compression="gzip")
                line = f"{value or ''}\n"
                held.append(line)
                size += len(line)
                if size >= held_bytes:
                    stream.write("".join(held).encode())
                    held, size = [], 0
            yield pd.DataFrame(done, columns=PART_COLUMNS)
        if stream is not None:
            yield pd.DataFrame([close()], columns=PART_COLUMNS)
    return run


def export_event_logs(lines: DataFrame, requests: DataFrame, out: str) -> None:
    """Write the raw lines of the requested applications as gzip text, one folder
    per (app_id, attempt_id).  A request without attempt exports every attempt.

    ``requests``: app_id, attempt_id (nullable).  Lines keep their order: an attempt's lines are cut
    by range into ordered part files, so a very large log is written by many tasks.  Tasks put their part
    files in place themselves, each under a temporary name first, and list them in ``<out>_parts``: with a
    folder per attempt, a commit that renames the folders one by one in the driver takes longer than the work.
    Where pyarrow cannot open ``out``, Spark's own writer is used.
    """
    spark = lines.sparkSession
    keys = attempts_of(parse_events(lines)).select("log", F.col("id").alias("app_id"),
                                      F.coalesce(F.col("attemptId"), F.lit("none")).alias("attempt_id"))
    r = requests.select("app_id", F.col("attempt_id").alias("want"))
    chosen = keys.join(r, (keys["app_id"] == r["app_id"])
                       & (r["want"].isNull() | (r["want"] == keys["attempt_id"])), "left_semi")
    place = [c for c in ("file_no", "block", "line") if c in lines.columns]
    picked = lines.join(chosen, "log").select("app_id", "attempt_id", *place, "value")
    order = ["app_id", "attempt_id", *place]
    rows = picked.repartitionByRange(*order).sortWithinPartitions(*order).drop(*place)
    out, top = out.rstrip("/"), readable_home(spark, out)
    for path in (out + PARTS_SUFFIX, out):
        fs, old = hadoop_folder(spark, path)
        fs.delete(old, True)
    if top is None:
        rows.write.mode("overwrite").partitionBy("app_id", "attempt_id").option("compression", "gzip").text(out)
        return
    rows.mapInPandas(_part_writer(top), PARTS).write.parquet(out + PARTS_SUFFIX)


def _part_reader():
    opener, lines_at_once = arrow_location, LINES_AT_ONCE

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for app, attempt, part, path in zip(*(pdf[c] for c in PART_COLUMNS)):
                fs, place = opener(path)
                with fs.open_input_stream(place, compression=None) as raw:
                    at, rest = 0, b""
                    for block in gunzip(raw):
                        *whole, rest = (rest + block).split(b"\n")
                        for line in whole:
                            rows.append((app, attempt, line.decode(), part, at))
                            at += 1
                            if len(rows) >= lines_at_once:
                                yield pd.DataFrame(rows, columns=LINE_COLUMNS)
                                rows = []
            yield pd.DataFrame(rows, columns=LINE_COLUMNS)
    return run


def read_exported(spark: SparkSession, out: str) -> DataFrame:
    """``app_id, attempt_id, value, part, at``: every exported line, its part file and its place there; parts are in the order of their names."""
    out = out.rstrip("/")
    fs, listed = hadoop_folder(spark, f"{out}{PARTS_SUFFIX}/_SUCCESS")
    if not fs.exists(listed):
        return spark.read.text(out).select(
            F.col("app_id").cast("string").alias("app_id"), F.col("attempt_id").cast("string").alias("attempt_id"), "value",
            F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("at"))
    parts = spark.read.schema(PARTS).parquet(out + PARTS_SUFFIX)
    return parts.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(_part_reader(), EXPORTED)


def event_lines_of(apps_flat: DataFrame, executors: DataFrame) -> DataFrame:
    """Event-log lines ``(log, value, line)`` of a flat application table (one row per attempt).

    One log per attempt; executors are added in the newest attempt's log, in the order of their ids.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    a = apps_flat.where(F.col("attempt_idx").isNotNull()).withColumn(
        "log", F.concat(F.lit("eventlog_v2_"), F.col("id"), F.lit("_"), F.col("attemptId")))
    start = a.select("log", F.to_json(F.struct(
        F.lit(EV_APP_START).alias("Event"), F.col("name").alias("App Name"), F.col("id").alias("App ID"),
        ms("startTime").alias("Timestamp"), F.lit("rollscope").alias("User"),
        F.col("attemptId").alias("App Attempt ID"))).alias("value"))
    end = a.where(F.col("completed")).select("log", F.to_json(F.struct(
        F.lit(EV_APP_END).alias("Event"), ms("endTime").alias("Timestamp"))).alias("value"))
    head = a.where(F.col("attempt_idx") == 0).select(F.col("id").alias("head_app"), "log")
    nth = F.row_number().over(Window.partitionBy("log").orderBy("id"))
    ex = executors.join(head, F.col("app_id") == F.col("head_app")).select("log", nth.alias("line"), F.to_json(F.struct(
        F.lit(EV_EXEC_ADDED).alias("Event"), ms("addTime").alias("Timestamp"),
        F.col("id").alias("Executor ID"),
        F.struct(F.col("hostPort").alias("Host"), F.col("totalTasks").alias("Total Cores"),
                 F.col("executorLogs").alias("Log Urls")).alias("Executor Info"))).alias("value"))
    return (start.withColumn("line", F.lit(0)).unionByName(end.withColumn("line", F.lit(1_000_000_000)))
            .unionByName(ex))


def write_event_logs(lines: DataFrame, out: str, layout: str = "table") -> None:
    """Store event lines: ``table`` = Parquet (log, value), few large files;
    ``folders`` = one text folder per log, the on-disk layout of event logs
    (fine for a few logs; one folder per attempt does not suit bulk staging)."""
    if layout == "table":
        lines.write.mode("overwrite").parquet(out)
    else:
        order = ["log", "line"] if "line" in lines.columns else ["log"]
        (lines.repartitionByRange(*order).sortWithinPartitions(*order).select("log", "value")
         .write.mode("overwrite").partitionBy("log").text(out))
