"""Restart index of gzip files: places from which a range can be unpacked without what stands before it.

Two kinds of places: the beginning of a member, and a byte-aligned flush point within a member (writers that
flush leave an empty stored block there) with the 32 KiB before it as dictionary.  The pass that counts a
file's bytes finds them.  A flush point is taken on proof only: a second stream is unpacked from it beside the
first, and the point holds for [raw_at, raw_end), over which both gave the same bytes.  Ranges without a point
are unpacked from the beginning of the file, as are files whose writers never flush.

Index rows (``INDEX_SCHEMA``): one a point; one a file with ``length`` (-1: cannot be unpacked) and no point.
A row counts for the file of that path, stored length and modification time only.  Windows (``bytes``) are read
by the task that unpacks; joins see the data file and row that hold them.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.functions.columns import GZ_SUFFIX
from rollscope.session import reliable_checkpoint
from rollscope.sources import files as fl
from rollscope.sources.storage import arrow_location, hadoop_folder, scan_log_files

SPACING = 1 << 20        # stored bytes between two points, at least
SPAN_BYTES = 64 << 20    # of uncompressed bytes: pieces and points meet in spans of a file
WINDOW = 1 << 15         # format constant: how far back a match can reach
FLUSH_MARK = b"\x00\x00\xff\xff"  # format constant: lengths of an empty stored block

INDEX_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("stored_length", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("stored_at", T.LongType()),
    T.StructField("raw_at", T.LongType()),
    T.StructField("raw_end", T.LongType()),
    T.StructField("bytes", T.BinaryType()),  # None: a member begins here
    T.StructField("length", T.LongType()),
])
FILE_KEY = ["path", "stored_length", "modified"]


class _Point:
    def __init__(self, stored_at: int, raw_at: int, window: bytes | None):
        self.stored_at, self.raw_at, self.window = stored_at, raw_at, window
        self.proof = None if window is None else _inflate_after(window)

    def row(self, raw_end: int):
        return self.stored_at, self.raw_at, raw_end, self.window, None


def _inflate_after(window: bytes):
    return zlib.decompressobj(-zlib.MAX_WBITS, zdict=window) if window else zlib.decompressobj(-zlib.MAX_WBITS)


def restart_points(raw, spacing: int = SPACING, block: int = 1 << 16):
    """(stored_at, raw_at, raw_end, window, None) of each point, then (None, None, None, None, length).

    Raises zlib.error or EOFError where the stream cannot be unpacked or ends within a member.
    """
    member, point, window, tail = None, None, b"", b""
    at = total = last = 0
    while buf := bytes(raw.read(block)):
        while buf:
            if member is None:
                padded = len(buf)
                buf = buf.lstrip(b"\0")
                at += padded - len(buf)
                if not buf:
                    break
                if at - last >= spacing:
                    if point:
                        yield point.row(total)
                    point, last = _Point(at, total, None), at
                member, window, tail = zlib.decompressobj(16 + zlib.MAX_WBITS), b"", b""
            due, cut, marked = max(last + spacing - at, 0), len(buf), False
            if due < len(buf):
                found = (tail + buf).find(FLUSH_MARK, max(due - len(FLUSH_MARK) + len(tail), 0))
                if found >= 0:
                    cut, marked = found + len(FLUSH_MARK) - len(tail), True
            part = buf[:cut]
            out = member.decompress(part)
            if point and point.proof:
                try:
                    same = point.proof.decompress(part) == out
                except zlib.error:
                    same = False
                if not same:
                    point, last = None, at + len(part) - spacing
                elif point.proof.eof:
                    point.proof = None  # the next member depends on nothing before it
            total += len(out)
            window = out[-WINDOW:] if len(out) >= WINDOW else (window + out)[-WINDOW:]
            tail = (tail + part)[-len(FLUSH_MARK) + 1:]
            rest = member.unused_data
            at += len(part) - len(rest)
            buf = rest + buf[cut:]
            if member.eof:
                member = None
            elif marked:
                if point:
                    yield point.row(total)
                point, last = _Point(at, total, window), at
    if member is not None:
        raise EOFError("gzip stream ends within a member")
    if point:
        yield point.row(total)
    yield None, None, None, None, total


def unpack_from(raw, window: bytes | None, block: int = 1 << 16):
    """Decompressed pieces of the stored bytes that follow a point (``window`` None: a member begins)."""
    if window is None:
        yield from fl.gunzip(raw, block)
        return
    d = _inflate_after(window)
    while not d.eof:
        buf = raw.read(block)
        if not buf:
            raise EOFError("gzip stream ends within a member")
        out = d.decompress(bytes(buf))
        if out:
            yield out
    rest = d.unused_data
    while len(rest) < 8:  # checksum and length of the member
        more = bytes(raw.read(block))
        if not more:
            raise EOFError("gzip stream ends within a member")
        rest += more
    yield from fl.gunzip(_After(rest[8:], raw), block)


class _After:
    """A stream with some bytes put back before it."""

    def __init__(self, first: bytes, raw):
        self.first, self.raw = first, raw

    def read(self, n: int) -> bytes:
        if self.first:
            out, self.first = self.first[:n], self.first[n:]
            return out
        return self.raw.read(n)


def read_from_point(path: str, lo: int, hi: int, stored_at: int, raw_at: int, window: bytes | None) -> bytes:
    """Uncompressed bytes [lo, hi) of a gzip file, unpacked from a point at or before ``lo``."""
    fs, p = arrow_location(path)
    got, pos = [], raw_at
    with fs.open_input_file(p) as file:
        file.seek(stored_at)
        for b in unpack_from(file, window):
            if pos + len(b) > lo:
                got.append(b[max(lo - pos, 0):hi - pos])
            pos += len(b)
            if pos >= hi:
                break
    piece = b"".join(got)
    if len(piece) < hi - lo:
        raise OSError(f"{path}: {len(piece)} of {hi - lo} bytes at {lo}; the file has changed")
    return piece


def _indexer(spacing: int, batch_rows: int = 256):
    points, opener, span, columns = restart_points, arrow_location, fl._Span, INDEX_SCHEMA.names

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for path, stored, modified in zip(*(pdf[c] for c in FILE_KEY)):
                fs, p = opener(path)
                with fs.open_input_file(p) as file:
                    try:
                        if file.size() < stored:
                            raise EOFError("the file is shorter than it was listed")
                        for row in points(span(file, 0, int(stored)), spacing):
                            rows.append((path, stored, modified, *row))
                            if len(rows) >= batch_rows:
                                yield _frame(pd, rows, columns)
                                rows = []
                    except (zlib.error, EOFError):
                        rows.append((path, stored, modified, None, None, None, None, -1))
            if rows:
                yield _frame(pd, rows, columns)
    return run


def _frame(pd, rows, columns):
    out = pd.DataFrame(rows, columns=columns)
    numbers = ["stored_at", "raw_at", "raw_end", "length"]
    return out.assign(**{c: out[c].astype("Int64") for c in numbers})


def build_restarts(files: DataFrame, spacing: int = SPACING) -> DataFrame:
    """Index rows of the gzip files among ``files`` (a listing); only names are shuffled, a task streams its files."""
    if spacing < 1:
        raise ValueError("spacing must be at least one byte")
    gz = files.where(F.col("path").endswith(GZ_SUFFIX)).select(*FILE_KEY)
    return gz.repartition(files.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(_indexer(spacing), INDEX_SCHEMA)


def read_restarts(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index without its windows: index rows, ``has_window``, ``data_file`` and ``row`` of the window."""
    fs, hpath = hadoop_folder(spark, path)
    if not fs.exists(hpath):
        return None
    rows = spark.read.schema(T.StructType([*INDEX_SCHEMA.fields, T.StructField("has_window", T.BooleanType())])).option(
        "recursiveFileLookup", "true").parquet(path)
    return rows.select(*FILE_KEY, "stored_at", "raw_at", "raw_end", "length", "has_window",
                       F.col("_metadata.file_path").alias("data_file"), F.col("_metadata.row_index").alias("row"))


def refresh_restarts(spark: SparkSession, home: str, path: str, spacing: int = SPACING,
                     snapshot: DataFrame | None = None) -> DataFrame:
    """Index the gzip files that are new or changed since the last call; returns ``read_restarts``.

    Rows go to ``batch=<token>`` (a hash of the file set) with overwrite, so a call that died and runs again
    rewrites the same folder. Rows of files that changed or vanished stay and match nothing. ``home`` must be on
    a storage that pyarrow can open.
    """
    from rollscope.sources.filetable import _batch_token
    listing = scan_log_files(spark, home, snapshot).where(F.col("path").endswith(GZ_SUFFIX)).select(*FILE_KEY)
    known = read_restarts(spark, path)
    if known is not None:
        listing = listing.join(known.where("length IS NOT NULL").select(*FILE_KEY), FILE_KEY, "left_anti")
    fresh = reliable_checkpoint(listing)  # pin the set being indexed
    if known is None or not fresh.isEmpty():
        (build_restarts(fresh, spacing).withColumn("has_window", F.col("bytes").isNotNull())
         .write.mode("overwrite").option("parquet.block.size", fl.ROW_GROUP_BYTES)
         .parquet(f"{path.rstrip('/')}/batch={_batch_token(fresh)}"))
    return read_restarts(spark, path)


def with_restart(pieces: DataFrame, files: DataFrame, restarts: DataFrame) -> DataFrame:
    """``pieces`` (path, lo) with ``restart``: the point whose range holds ``lo``, or NULL.

    ``files`` says which generation of each path counts. Points and pieces meet on (path, span of ``SPAN_BYTES``),
    a point in every span that its range touches, so a piece sees the points of one span, however long the file.
    """
    span = F.lit(SPAN_BYTES)

    def number(c: Column) -> Column:
        return F.floor(c / span).cast("long")

    current = files.where(F.col("path").endswith(GZ_SUFFIX)).select(*FILE_KEY)
    points = restarts.where(F.col("raw_end") > F.col("raw_at")).join(current, FILE_KEY, "left_semi")
    points = points.select(
        F.col("path").alias("_path"), F.explode(F.sequence(number(F.col("raw_at")), number(F.col("raw_end") - 1))).alias("_span"),
        F.struct("stored_at", "raw_at", F.when(F.col("has_window"), F.col("data_file")).alias("place"), "row").alias("restart"),
        F.col("raw_end").alias("_raw_end"))
    on = ((F.col("place") == F.col("_path")) & (number(F.col("lo")) == F.col("_span"))
          & (F.col("lo") >= F.col("restart.raw_at")) & (F.col("lo") < F.col("_raw_end")))
    return pieces.join(points, on, "left").drop("_path", "_span", "_raw_end")
