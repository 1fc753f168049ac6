"""Event logs as mergeable state: a refresh parses only the lines that are new.

What the application and executor tables need of a log is a minimum, maxima, a flag and a set of executor
rows, all of which merge.  So the state keeps them per file of a log, in rows that a later refresh adds to:

* a plain file that grew (known beginning unchanged, by the digest of its ends) is read from its last whole
  line on, in ranges that several tasks share;
* a last line without its end counts (``tail`` rows), until the file changes and the line is read again;
* any other changed file, compressed ones included, is another generation (``gen``) and is read whole;
* files that vanished, or that a newer compacted file replaces, no longer count: nothing is subtracted.

Layout: ``<state>/<kind>/seq=<n>/`` for the kinds ``attempts``, ``added``, ``removed`` and, written last,
``files``.  A number counts once Spark has marked its ``files`` complete, so a refresh that dies leaves the
state as it was and its successor writes over the same folders.  ``<state>/base_<kind>/seq=<n>/`` hold
everything up to n, written every 16th refresh.  One refresh of a state runs at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.session import reliable_checkpoint
from rollscope.sources import eventlog as evl
from rollscope.sources import filetable as ft
from rollscope.sources.files import gunzip, prefix_digest
from rollscope.sources.storage import arrow_location, list_home, readable_home

BLOCK = 8 << 20
PART_BYTES = 128 << 20  # of a plain file, for one task
COMPACT_AFTER = 16      # refreshes read together before a base is written

_BY = ["path", "log", "gen", "tail"]
_KEYS = "path string, log string, gen long, tail boolean"
SCHEMAS = {
    "attempts": f"{_KEYS}, id string, name string, attemptId string, start_ms long, end_ms long, completed boolean, at long",
    "added": f"{_KEYS}, id string, add_ms long, host string, totalCores int, executorLogs map<string,string>, at long",
    "removed": f"{_KEYS}, id string, remove_ms long, removeReason string, at long",
    "files": "path string, log string, stored_length long, modified timestamp, parsed long, digest binary, "
             "gen long, gone boolean, read_error boolean, at long",
}
_PARSED = ["attempts", "added", "removed"]
_WANTED = re.compile("|".join((evl.EV_APP_START, evl.EV_APP_END, evl.EV_EXEC_ADDED, evl.EV_EXEC_REMOVED)).encode())
_PACKED = r"\.(gz|zst|zstd|lz4|lzf|snappy)(\.inprogress|\.compact)*$"


def owned_lines(blocks: Iterator[bytes], base: int, skip: bool, hi: int) -> Iterator[tuple[bytes, int, bool]]:
    """The lines that begin before ``hi``, as (bytes, position behind the last whole line, without its end?).

    ``blocks`` follow each other from position ``base``; with ``skip``, the first line begun there is another's.
    """
    rest = b""
    for block in blocks:
        if skip:
            cut = block.find(b"\n") + 1
            base += cut or len(block)
            if not cut:
                continue
            block, skip = block[cut:], False
        if base >= hi:
            return
        rest += block
        if base + len(rest) >= hi:
            end = rest.find(b"\n", max(hi - 1 - base, 0)) + 1
            if end:
                yield rest[:end], base + end, False
                return
        end = rest.rfind(b"\n") + 1
        if end:
            yield rest[:end], base + end, False
            base, rest = base + end, rest[end:]
    if rest and base < hi:
        yield rest, base, True


def wanted_lines(block: bytes) -> Iterator[bytes]:
    """The lines of a block that name one of the parsed events; others are never decoded."""
    at = 0
    while m := _WANTED.search(block, at):
        lo = max(block.rfind(b"\n", at, m.start()) + 1, at)
        end = block.find(b"\n", m.end())
        at = len(block) if end < 0 else end
        yield block[lo:at].strip(b"\r\n")


def _plain(file, at: int, end: int) -> Iterator[bytes]:
    while at < end:
        block = file.read_at(min(BLOCK, end - at), at)
        if not block:
            raise EOFError("the file is shorter than it was listed")
        at += len(block)
        yield block


def _unpacked(stream, codec: str) -> Iterator[bytes]:
    import zstandard
    if codec == "gz":
        yield from gunzip(stream, BLOCK)
    elif codec in ("zst", "zstd"):
        reader = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
        while block := reader.read(BLOCK):
            yield block
    else:
        raise EOFError(f"{codec}: only the writing program's own block format")


def _line_reader():
    packed, opener, columns = re.compile(_PACKED), arrow_location, [*_BY, "value", "parsed", "broken"]

    def run(batches):
        import zlib

        import pandas as pd
        import zstandard
        for pdf in batches:
            for path, log, gen, start, lo, hi, size in pdf[["path", "log", "gen", "start", "lo", "hi", "size"]].itertuples(index=False):
                fs, place = opener(path)
                codec, parsed, broken = packed.search(path), int(start), False
                try:
                    if codec:
                        with fs.open_input_stream(place, compression=None) as f:
                            found = owned_lines(_unpacked(f, codec.group(1)), 0, False, 1 << 62)
                            for block, _, tail in found:
                                rows = [(path, log, gen, tail, v.decode("utf-8", "replace"), None, None) for v in wanted_lines(block)]
                                yield pd.DataFrame(rows, columns=columns)
                    else:
                        skip = lo > start
                        with fs.open_input_file(place) as f:
                            for block, end, tail in owned_lines(_plain(f, lo - skip, size), lo - skip, skip, hi):
                                parsed = end
                                rows = [(path, log, gen, tail, v.decode("utf-8", "replace"), None, None) for v in wanted_lines(block)]
                                yield pd.DataFrame(rows, columns=columns)
                except (EOFError, zlib.error, zstandard.ZstdError):  # the content; a failed access fails the task
                    broken = True
                yield pd.DataFrame([(path, log, gen, False, None, 0 if codec else parsed, broken)], columns=columns)
    return run


def _digester():
    packed, opener, digest = re.compile(_PACKED), arrow_location, prefix_digest

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for path, parsed in zip(pdf["path"], pdf["parsed"]):
                mark = None
                if parsed > 0 and not packed.search(path):
                    fs, place = opener(path)
                    with fs.open_input_file(place) as f:
                        mark = digest(f, int(parsed)) if f.size() >= parsed else None
                out.append((path, mark))
            yield pd.DataFrame(out, columns=["path", "digest"])
    return run


def _digests(files: DataFrame) -> DataFrame:
    """(path, digest) of the first ``parsed`` bytes of plain files."""
    return files.select("path", "parsed").mapInPandas(_digester(), "path string, digest binary")


def live_files(listing: DataFrame) -> DataFrame:
    """path, log, stored_length, modified of the files that count, by their names alone.

    Names beginning with ``_`` or ``.`` are not logs. A rolled log's newest compacted file replaces all up to its number.
    """
    rolled = ~F.col("_top") & F.col("app").rlike("(^|=)eventlog_v2_")
    number = F.regexp_extract("file_name", r"^events_(\d+)_", 1).try_cast("int")
    files = listing.where(F.col("file_name").isNotNull() & ~F.col("file_name").rlike("^[_.]")).select(
        "path", "stored_length", "modified", rolled.alias("rolled"), F.when(rolled, F.col("app")).otherwise(
            F.regexp_replace("file_name", r"(\.(gz|zst|zstd|lz4|lzf|snappy|inprogress))+$", "")).alias("log"),
        F.when(rolled, number).alias("n"), F.col("file_name").endswith(".compact").alias("compact"))
    newest = files.where("compact AND n IS NOT NULL").groupBy(F.col("log").alias("_log")).agg(F.max("n").alias("upto"))
    kept = files.join(newest, F.col("rolled") & (F.col("log") == F.col("_log")), "left").where(
        "n IS NULL OR upto IS NULL OR n > upto OR (n = upto AND compact)")
    return kept.select("path", "log", "stored_length", "modified")


def _entries(spark: SparkSession, state: str) -> tuple[int | None, list[int]]:
    """(the newest base, the refreshes after it)."""
    base = max(ft._whole(spark, state, "base_files"), default=None)
    return base, [n for n in ft._whole(spark, state, "files") if base is None or n > base]


def _read(spark: SparkSession, state: str, kind: str) -> DataFrame:
    base, numbers = _entries(spark, state)
    places = [f"{state}/{kind}/seq={n}" for n in numbers] + ([] if base is None else [f"{state}/base_{kind}/seq={base}"])
    return spark.read.schema(SCHEMAS[kind]).parquet(*places) if places else spark.createDataFrame([], SCHEMAS[kind])


def read_files(spark: SparkSession, state: str) -> DataFrame:
    """The files whose lines count: the newest row of each path."""
    rows = _read(spark, state.rstrip("/"), "files")
    return rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "at").alias("r")).select("r.*").where("NOT gone")


def _live(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    """The rows of each kind that count now."""
    files = read_files(spark, state).select("path", F.col("gen").alias("_gen"), F.col("at").alias("_at"))
    return {kind: _read(spark, state, kind).join(files, "path")
            .where("gen = _gen AND (NOT tail OR at = _at)").drop("_gen", "_at") for kind in _PARSED}


def _merged(rows: dict[str, DataFrame], by: list[str], *more) -> dict[str, DataFrame]:
    attempts = rows["attempts"].groupBy(*by).agg(
        F.max("id").alias("id"), F.max("name").alias("name"), F.max("attemptId").alias("attemptId"), F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"), F.bool_or("completed").alias("completed"), *more)
    removed = rows["removed"].groupBy(*by, "id").agg(
        F.max("remove_ms").alias("remove_ms"), F.max("removeReason").alias("removeReason"), *more)
    return {"attempts": attempts, "added": rows["added"], "removed": removed}


def read_event_state(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame]:
    """(applications, executors), the same rows as ``event_logs_to_tables`` gives for the files read so far."""
    rows = _merged(_live(spark, state.rstrip("/")), ["log"])
    return evl.tables_of(rows["attempts"], rows["added"].select("log", "id", "add_ms", "host", "totalCores", "executorLogs"), rows["removed"])


def compact(spark: SparkSession, state: str) -> None:
    """Write a base of everything that counts; a file's rows are merged, executor rows stay."""
    state = state.rstrip("/")
    _, numbers = _entries(spark, state)
    if numbers:
        parts = {**_merged(_live(spark, state), _BY, F.max("at").alias("at")), "files": read_files(spark, state)}
        for kind in [*_PARSED, "files"]:
            _write(parts[kind], state, f"base_{kind}", kind, numbers[-1])


def _write(rows: DataFrame, state: str, folder: str, kind: str, number: int) -> None:
    columns = [c.split(" ")[0] for c in SCHEMAS[kind].split(", ")]
    rows.select(*columns).hint("rebalance").write.mode("overwrite").parquet(f"{state}/{folder}/seq={number}")


def refresh_event_state(spark: SparkSession, root: str, state: str, part_bytes: int = PART_BYTES,
                        compact_after: int = COMPACT_AFTER) -> bool:
    """Bring the state up to date with the event logs below ``root``; whether anything was new.

    Logs are laid out as for ``read_event_lines``: rolled folders and single files, plain, gzip or zstd. A
    compressed file that is cut or broken, or in a block format of its own (lz4, lzf, snappy), counts as far as
    it can be read and is marked ``read_error`` in ``read_files``. An empty root gives empty tables. Needs a
    storage that pyarrow can open.
    """
    state = state.rstrip("/")
    if readable_home(spark, root) is None:
        raise ValueError(f"pyarrow has no file system for {root}")
    known = reliable_checkpoint(read_files(spark, state))
    listing = reliable_checkpoint(live_files(list_home(spark, root)))
    gone = known.join(listing.select("path"), "path", "left_anti")
    was = known.select("path", F.col("stored_length").alias("_length"), F.col("modified").alias("_modified"),
                       F.col("parsed").alias("_parsed"), F.col("digest").alias("_digest"), F.col("gen").alias("_gen"), "read_error")
    changed = reliable_checkpoint(listing.join(was, "path", "left").where(
        "_length IS NULL OR stored_length != _length OR modified != _modified"))
    if changed.isEmpty() and gone.isEmpty():
        return False
    base, numbers = _entries(spark, state)
    number = max([*numbers, base or 0]) + 1

    longer = changed.where("stored_length > _length AND _digest IS NOT NULL AND NOT read_error")
    now = _digests(longer.withColumn("parsed", F.col("_parsed"))).withColumnRenamed("digest", "_now")
    grew = F.coalesce(F.col("_now") == F.col("_digest"), F.lit(False))
    fresh = reliable_checkpoint(changed.join(now, "path", "left").select(
        "path", "log", "stored_length", "modified", F.when(grew, F.col("_parsed")).otherwise(0).cast("long").alias("start"),
        F.when(grew, F.col("_gen")).otherwise(number).cast("long").alias("gen")))

    size, step = F.col("stored_length"), F.lit(part_bytes).cast("long")
    split = F.sequence(F.col("start"), F.greatest(F.col("start"), size - 1), step)
    parts = fresh.select("path", "log", "gen", "start", size.alias("size"), F.explode(
        F.when(F.col("path").rlike(_PACKED), F.array("start")).otherwise(split)).alias("lo"))
    parts = parts.withColumn("hi", F.least(F.col("lo") + step, F.col("size")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(fresh.select(F.sum(size - F.col("start"))).first()[0] or 0) // part_bytes))
    read = reliable_checkpoint(parts.repartition(tasks, "path", "lo").mapInPandas(
        _line_reader(), f"{_KEYS}, value string, parsed long, broken boolean"))

    events = evl.parse_events(read.where("value IS NOT NULL"), _BY)
    found = {"attempts": evl.attempts_of(events, _BY), "added": evl.executors_added(events, _BY), "removed": evl.executors_removed(events, _BY)}
    for kind in _PARSED:
        _write(found[kind].withColumn("at", F.lit(number).cast("long")), state, kind, kind, number)
    marks = read.where("value IS NULL").groupBy("path").agg(F.max("parsed").alias("parsed"), F.bool_or("broken").alias("read_error"))
    done = reliable_checkpoint(fresh.join(marks, "path"))
    files = done.join(_digests(done), "path").withColumn("gone", F.lit(False)).withColumn("at", F.lit(number).cast("long"))
    lost = gone.withColumn("gone", F.lit(True)).withColumn("at", F.lit(number).cast("long"))
    columns = lost.columns
    _write(files.select(*columns).unionByName(lost), state, "files", "files", number)
    if len(numbers) + 1 >= compact_after:
        compact(spark, state)
    return True
