"""Byte-range slices of logical logs, answered for a whole table of requests.

Request table: ``request_id, app, pod, log_type, offset (NULL = tail), byte_length``.

Plan (each step is a DataFrame operation on metadata; bytes are never shuffled):

1. distinct (app, pod) of the requests -> manifest (rank + offsets per file, total per log)
2. per-log totals, directory existence -> resolved window and status
3. windows cut into parts of bounded size; range join of parts and files over nested blocks of the byte
   axis, so that a log with many files and many requests never pairs every request with every file
4. local byte ranges -> chunk locators (path, rows of a data file)
5. pieces regrouped per part, ordered; each part's bytes are read by one task

Chunk tables without locators (plain DataFrames) are joined on (path, chunk_no) instead of steps 4 and 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions.columns import (
    DEFAULT_BYTE_LENGTH,
    log_dir,
    lossy_utf8,
    resolve_window,
    slice_header,
)
from rollscope.operators import manifest as mf

DEFAULT_CHUNK_BYTES = 1 << 16
DEFAULT_BUCKET_BYTES = 1 << 22
RADIX = 16                # blocks of one level in a block of the next
PART_BYTES = 64 << 20     # of a slice in one row; larger slices come as several rows

STATUS_OK = "ok"
STATUS_BAD_REQUEST = "bad_request"
STATUS_MISSING_DIR = "missing_dir"
STATUS_NOT_A_DIRECTORY = "not_a_directory"
STATUS_READ_ERROR = "read_error"
STATUS_NEGATIVE_LENGTH = "negative_length"

_BLOCKS = "array<struct<level:int,block:bigint,whole:boolean>>"
_LEVELS = 10  # 16^10 blocks of level 0 are more than any log

REQUEST_COLUMNS = ["request_id", "app", "pod", "log_type", "offset", "byte_length"]
WINDOW_COLUMNS = REQUEST_COLUMNS + ["start_byte", "end_byte", "total_bytes", "status"]


CARRY = "_carry"  # further request columns on their way to the result, packed in one struct


def normalize_requests(requests: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Fill optional request columns: log type label, default byte length; ``carry`` names further ones to keep."""
    r = requests
    if "log_type" not in r.columns:
        r = r.withColumn("log_type", F.lit(None).cast("string"))
    if "offset" not in r.columns:
        r = r.withColumn("offset", F.lit(None).cast("long"))
    if "byte_length" not in r.columns:
        r = r.withColumn("byte_length", F.lit(DEFAULT_BYTE_LENGTH))
    return r.select(
        "request_id", F.col("app").cast("string").alias("app"), F.col("pod").cast("string").alias("pod"),
        F.col("log_type").cast("string").alias("log_type"), F.col("offset").cast("long").alias("offset"),
        F.coalesce(F.col("byte_length").cast("long"), F.lit(DEFAULT_BYTE_LENGTH)).alias("byte_length"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias(CARRY)] if carry else []))


def requested_logs(requests: DataFrame) -> DataFrame:
    """Each (app, pod) asked for, once -- a log asked for often is ranked once."""
    return (requests.where(F.col("app").isNotNull() & F.col("pod").isNotNull())
            .select("app", "pod").distinct())


def resolve_requests(requests: DataFrame, totals: DataFrame, dirs: DataFrame) -> DataFrame:
    """Window (start, end, total) and status of every request.

    ``dirs`` has ``dir_app`` and optionally ``is_dir`` (False for a plain file
    standing where the application directory should be).  Error outcomes carry
    start = end = total = 0.
    """
    if "is_dir" not in dirs.columns:
        dirs = dirs.withColumn("is_dir", F.lit(True))
    j = (requests.join(totals, ["app", "pod"], "left")
         .join(dirs.select("dir_app", "is_dir"), F.col("app") == F.col("dir_app"), "left"))
    total = F.coalesce(F.col("total_bytes"), F.lit(0).cast("long"))
    start, end = resolve_window(F.col("offset"), F.col("byte_length"), total)
    # a file of the log cannot be unpacked: offsets on its byte axis are unknown
    broken = F.coalesce(F.col("read_error"), F.lit(False)) if "read_error" in totals.columns else F.lit(False)
    status = (F.when(F.col("app").isNull() | F.col("pod").isNull(), F.lit(STATUS_BAD_REQUEST))
              .when(F.col("dir_app").isNull(), F.lit(STATUS_MISSING_DIR))
              .when(~F.col("is_dir"), F.lit(STATUS_NOT_A_DIRECTORY))
              .when(broken, F.lit(STATUS_READ_ERROR))
              .when(end < start, F.lit(STATUS_NEGATIVE_LENGTH))
              .otherwise(F.lit(STATUS_OK)))
    ok = status == STATUS_OK
    zero = F.lit(0).cast("long")
    return j.select(
        *REQUEST_COLUMNS, *([CARRY] if CARRY in requests.columns else []),
        F.when(ok, start).otherwise(zero).alias("start_byte"),
        F.when(ok, end).otherwise(zero).alias("end_byte"),
        F.when(ok, total).otherwise(zero).alias("total_bytes"),
        status.alias("status"))


def blocks(lo: Column, hi: Column, bucket_bytes: int, most: Column | None = None) -> Column:
    """Blocks of the half-open byte range [lo, hi), hi > lo, as an array of (level, block, whole).

    Level 0 are blocks of ``bucket_bytes``; RADIX blocks make one of the next level. The range, rounded out to
    level 0, is taken apart into the fewest ``whole`` blocks (at most 2 * RADIX a level); with ``most``, the
    blocks around them up to that level are listed too, not ``whole`` (at most two a level).
    """
    # level by level: [a, b) blocks are left; those outside the next level's whole blocks are taken here
    a0, b0 = F.floor(lo / F.lit(bucket_bytes)).cast("long"), (F.floor((hi - 1) / F.lit(bucket_bytes)) + 1).cast("long")
    radix = F.lit(RADIX).cast("long")

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        up, down = F.ceil(a / radix).cast("long"), F.floor(b / radix).cast("long")
        rises = up < down
        left = F.when(rises, up * radix).otherwise(b)
        right = F.when(rises, down * radix).otherwise(b)

        def own(x: Column, y: Column) -> Column:
            return F.when(x < y, F.transform(F.sequence(x, y - 1), lambda k: F.struct(
                level.alias("level"), k.alias("block"), F.lit(True).alias("whole")))).otherwise(F.array().cast(_BLOCKS))

        taken = F.concat(state["out"], own(a, left), own(right, b))
        return F.struct(F.when(rises, up).otherwise(F.lit(0).cast("long")).alias("a"),
                        F.when(rises, down).otherwise(F.lit(0).cast("long")).alias("b"), taken.alias("out"))

    start = F.struct(a0.alias("a"), b0.alias("b"), F.array().cast(_BLOCKS).alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, step, lambda x: x["out"])
    if most is None:
        return whole

    def around(level: Column) -> Column:
        width = F.pow(F.lit(float(RADIX)), level).cast("long")
        first, last = F.floor(a0 / width).cast("long"), F.floor((b0 - 1) / width).cast("long")
        edges = F.array_distinct(F.array(first, last))
        return F.transform(edges, lambda k: F.struct(level.alias("level"), k.alias("block"), F.lit(False).alias("whole")))

    outer = F.when(most >= 1, F.flatten(F.transform(F.sequence(F.lit(1), most), around))).otherwise(F.array().cast(_BLOCKS))
    # an edge block may be one of the whole blocks, or lie within one: then it is not around anything
    inside = F.filter(outer, lambda e: ~F.exists(whole, lambda w: (w["level"] >= e["level"]) & (
        F.floor(e["block"] / F.pow(F.lit(float(RADIX)), w["level"] - e["level"]).cast("long")) == w["block"])))
    return F.concat(whole, inside)


def overlap(windows: DataFrame, manifest: DataFrame,
            bucket_bytes: int = DEFAULT_BUCKET_BYTES, keep_empty: bool = False, longest: int | None = None) -> DataFrame:
    """Range join: the files each window overlaps and the local range in each.

    The window's own columns ride along, so no join back is needed later.  With ``keep_empty``,
    windows without bytes stay too, with NULL file columns (a window may then also have such
    rows beside its files), so that one pass answers every request.

    Both sides are taken apart into blocks of a hierarchy (`blocks`): a window of any size makes few rows, and
    two ranges overlap where a whole block of one is, or lies within, a block of the other. Blocks around a
    range are only listed up to the largest whole block of the other side (a scalar subquery), which is level
    0 while all windows and files are small. A pair is kept once: in the smaller block at its first common byte.
    A block that very many windows share is split by the adaptive skew join. ``longest``: no window has more bytes.
    """
    carry = list(windows.columns)
    filled = (F.col("status") == STATUS_OK) & (F.col("end_byte") > F.col("start_byte"))
    files = manifest.where(F.col("file_end") > F.col("file_start"))

    def highest(longest: DataFrame) -> Column:
        # a range of n bytes touches n / bucket_bytes + 2 blocks of level 0 at most
        level = F.floor(F.log(F.greatest(F.col("n"), F.lit(0)) / bucket_bytes + 2) / F.log(F.lit(float(RADIX))) + 1e-9)
        return F.coalesce(longest.select(F.least(level, F.lit(_LEVELS)).cast("int").alias("n")).scalar(), F.lit(0))

    # bounds that need no rank, offset or total: the longest file, the longest request
    size = F.col("length") if "length" in files.columns else F.col("file_end") - F.col("file_start")
    asked = F.col("byte_length") if "byte_length" in windows.columns else F.col("end_byte") - F.col("start_byte")
    of_files = highest(manifest.agg(F.max(size).alias("n")))
    of_windows = highest(windows.agg(F.max(asked if longest is None else F.least(asked, F.lit(longest))).alias("n")))
    w = windows.withColumn("_most", of_files)
    span = F.when(filled, blocks(F.col("start_byte"), F.col("end_byte"), bucket_bytes, F.col("_most")))
    w = (w.withColumn("_block", F.explode_outer(span)) if keep_empty
         else w.where(filled).withColumn("_block", F.explode(span)))
    w = w.select(*carry, F.col("_block.level").alias("_level"), F.col("_block.block").alias("_at"), F.col("_block.whole").alias("_whole"))
    extra = [c for c in ("segments", "app_bucket") if c in manifest.columns]
    m = (files.select("app", "pod", "path", "file_rank", "file_start", "file_end", *extra).withColumn("_most", of_windows)
         .withColumn("_block", F.explode(blocks(F.col("file_start"), F.col("file_end"), bucket_bytes, F.col("_most"))))
         .select(F.col("app").alias("_app"), F.col("pod").alias("_pod"), "path", "file_rank", "file_start", "file_end", *extra,
                 F.col("_block.level").alias("_flevel"), F.col("_block.block").alias("_fat"), F.col("_block.whole").alias("_fwhole")))
    lo = F.greatest(F.col("start_byte"), F.col("file_start"))
    hi = F.least(F.col("end_byte"), F.col("file_end"))
    width = F.pow(F.lit(float(RADIX)), F.col("_level")).cast("long") * F.lit(bucket_bytes)
    # the first common byte lies in exactly one whole block of each side; the pair is kept in the larger of the
    # two, where the other side is listed as around it (or as the same block)
    j = w.join(m, (F.col("app") == F.col("_app")) & (F.col("pod") == F.col("_pod"))
               & (F.col("_level") == F.col("_flevel")) & (F.col("_at") == F.col("_fat"))
               & (F.col("_whole") | F.col("_fwhole")) & (lo < hi)
               & (F.floor(lo / width) == F.col("_at")), "left" if keep_empty else "inner")
    return j.select(*carry, "path", "file_rank", *extra,
                    (lo - F.col("file_start")).alias("local_start"),
                    (hi - F.col("file_start")).alias("local_end"))


def by_segment(pieces: DataFrame) -> DataFrame:
    """``pieces`` cut at the borders of their file's segments: chunk_batch, seg_start, and local ranges within the segment."""
    nexts = F.transform("segments", lambda x, i: F.struct(
        x["batch"].alias("batch"), x["start"].alias("start"), F.get(F.col("segments"), i + 1)["start"].alias("end")))
    hit = F.filter(nexts, lambda x: (x["start"] < F.col("local_end"))
                   & (x["end"].isNull() | (x["end"] > F.col("local_start"))) & (x["end"].isNull() | (x["end"] > x["start"])))
    rows = pieces.withColumn("_seg", F.explode_outer(F.when(F.col("local_end") > F.col("local_start"), hit)))
    start = F.col("_seg.start")
    lo, hi = F.greatest(F.col("local_start"), start) - start, F.least(F.col("local_end"), F.col("_seg.end")) - start
    return rows.select(*(c for c in pieces.columns if c not in ("segments", "local_start", "local_end")),
                       F.col("_seg.batch").alias("chunk_batch"), start.alias("seg_start"),
                       F.when(start.isNotNull(), lo).alias("local_start"), F.when(start.isNotNull(), hi).alias("local_end"))


def locate(pieces: DataFrame, locators: DataFrame, chunk_bytes: int) -> DataFrame:
    """``pieces`` with the rows of the data files that hold them: place, row, and the range [lo, hi) from that row on.

    An equi join on the path (and batch); pieces without a file stay, with a NULL place.
    """
    C = F.lit(chunk_bytes)
    p = by_segment(pieces) if "segments" in pieces.columns else pieces.withColumn("seg_start", F.lit(0).cast("long"))
    keys = ["path", *(["chunk_batch"] if "chunk_batch" in locators.columns and "chunk_batch" in p.columns else [])]
    first, last = F.floor(F.col("local_start") / C).cast("long"), F.floor((F.col("local_end") - 1) / C).cast("long")
    p = p.withColumn("_first", first).withColumn("_last", last)
    at = locators.select(*(F.col(k).alias(f"_{k}") for k in keys), "data_file", "first_chunk", "last_chunk", "shift")
    on = (F.col("first_chunk") <= F.col("_last")) & (F.col("last_chunk") >= F.col("_first"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    j = p.join(at, on, "left")
    run = F.greatest(F.col("_first"), F.col("first_chunk"))
    lo = F.greatest(F.col("local_start"), F.col("first_chunk") * C)
    hi = F.least(F.col("local_end"), (F.col("last_chunk") + 1) * C)
    return j.select(*(c for c in pieces.columns if c not in ("local_start", "local_end", "segments", "app_bucket")),
                    (F.col("seg_start") + lo).alias("at"), run.alias("chunk_no"), F.col("data_file").alias("place"), (run + F.col("shift")).alias("row"),
                    (lo - run * C).alias("lo"), (hi - run * C).alias("hi"))


def fetch_chunks(pieces: DataFrame, chunks: DataFrame,
                 chunk_bytes: int = DEFAULT_CHUNK_BYTES, keep_empty: bool = False) -> DataFrame:
    """Bytes of each (request, file, local range) from a chunk table that is joined.

    Local ranges become chunk numbers; only those chunks are joined, on
    ``(path, chunk_no)``, which also spreads one huge log over many tasks.
    With ``keep_empty``, rows without a file stay, with a NULL piece.
    """
    C = F.lit(chunk_bytes)
    if "segments" in pieces.columns:
        pieces = by_segment(pieces)
    filled = F.col("local_end") > F.col("local_start")
    numbers = F.when(filled, F.sequence(F.floor(F.col("local_start") / C).cast("long"),
                                        F.floor((F.col("local_end") - 1) / C).cast("long")))
    p = (pieces.withColumn("chunk_no", F.explode_outer(numbers)) if keep_empty
         else pieces.where(filled).withColumn("chunk_no", F.explode(numbers)))
    keys = ["path", "chunk_no"]
    if "chunk_batch" in chunks.columns and "chunk_batch" in p.columns:
        # persisted chunk tables hold one folder per ingestion batch; the file
        # table names the batches holding each file's current bytes
        keys = ["chunk_batch"] + keys
    if "app_bucket" in chunks.columns:
        # stored chunk tables are bucketed by app: joining on the bucket lets
        # dynamic partition pruning skip the buckets no request needs.  The file
        # table records each file's bucket; without it the default count is used.
        if "app_bucket" not in p.columns:
            from rollscope.sources.files import app_bucket
            p = p.withColumn("app_bucket", app_bucket(F.col("app")))
        keys = ["app_bucket"] + keys
    c = chunks.select(*keys[:-1], F.col("chunk_no").cast("long").alias("chunk_no"), "bytes")
    j = p.join(c, keys, "left" if keep_empty else "inner")
    base = F.col("chunk_no") * C
    lo = F.greatest(F.col("local_start"), base) - base
    hi = F.least(F.col("local_end"), base + C) - base
    return j.select(*[c_ for c_ in p.columns if c_ not in ("bytes", "app_bucket", "chunk_batch")],
                    F.col("bytes").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


_PIECE = ["file_rank", "at", "place", "row", "lo", "hi"]


def fetch_located(pieces: DataFrame, locators: DataFrame, chunk_bytes: int = DEFAULT_CHUNK_BYTES) -> DataFrame:
    """Like ``fetch_chunks`` from the stored chunk table: one row a chunk, its bytes read where its locator says."""
    from rollscope.sources.files import read_units
    C = F.lit(chunk_bytes)
    found = locate(pieces, locators, chunk_bytes).where("place IS NOT NULL")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - 1) / C).cast("long")))
    rows = found.withColumn("_k", k).where((F.col("_k") + 1) * C > F.col("lo"))
    one = F.struct("file_rank", "at", "place", (F.col("row") + F.col("_k")).alias("row"),
                   (F.greatest(F.col("lo"), F.col("_k") * C) - F.col("_k") * C).alias("lo"),
                   (F.least(F.col("hi"), (F.col("_k") + 1) * C) - F.col("_k") * C).alias("hi"))
    rows = rows.withColumn("chunk_no", F.col("chunk_no") + F.col("_k")).withColumn("pieces", F.array(one))
    return read_units(rows.drop("at", "place", "row", "lo", "hi", "_k"), chunk_bytes).withColumnRenamed("bytes", "piece")


def assemble_located(pieces: DataFrame, locators: DataFrame | None, keys: list[str],
                     chunk_bytes: int = DEFAULT_CHUNK_BYTES, per_file: bool = False,
                     files: DataFrame | None = None, restarts: DataFrame | None = None) -> DataFrame:
    """Slices by ``keys``: ``bytes`` (with ``per_file``: ``by_file``, the bytes of each file's piece).

    The places of a slice's pieces are gathered in order, then read by one task; no bytes are shuffled.
    ``locators`` None: the pieces are read from the log files themselves; with ``restarts`` (the restart index of
    ``files``) a gzip file is unpacked from the point next before the piece.
    """
    from rollscope.sources.files import read_units
    columns = _PIECE
    if locators is None:
        found = pieces.withColumnsRenamed({"path": "place", "local_start": "lo", "local_end": "hi"}).withColumn(
            "at", F.col("lo")).withColumn("row", F.lit(None).cast("long"))
        if restarts is not None:
            from rollscope.sources.gzindex import with_restart
            found, columns = with_restart(found, files, restarts), [*_PIECE, "restart"]
    else:
        found = locate(pieces, locators, chunk_bytes)
    piece = F.when(F.col("place").isNotNull(), F.struct(*columns))
    units = found.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return read_units(units, chunk_bytes, per_file)


def _joined_bytes(fetched: DataFrame) -> Column:
    """The group's pieces in order, as one binary value."""
    order = ", ".join(c for c in ("file_rank", "seg_start", "chunk_no") if c in fetched.columns)
    return F.coalesce(F.expr(f"listagg(piece, X'') WITHIN GROUP (ORDER BY {order})"), F.lit(b""))


def assemble(fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Concatenate fetched pieces of every slice in (file_rank, chunk_no) order: ``slice_hex``."""
    return fetched.groupBy(*keys).agg(_joined_bytes(fetched).alias("b")).select(*keys, F.hex("b").alias("slice_hex"))


def assemble_joined(fetched: DataFrame, keys: list[str], per_file: bool = False) -> DataFrame:
    """Like ``assemble_located`` for pieces that were joined from a chunk table."""
    if not per_file:
        return fetched.groupBy(*keys).agg(_joined_bytes(fetched).alias("bytes"))
    files = fetched.groupBy(*keys, "file_rank").agg(_joined_bytes(fetched).alias("b"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("file_rank").isNotNull(), F.struct("file_rank", "b"))))
    return files.groupBy(*keys).agg(F.transform(ranked, lambda x: x["b"]).alias("by_file"))


def _in_parts(windows: DataFrame, part_bytes: int) -> DataFrame:
    """Each window as parts of at most ``part_bytes``: part, _start and _end of the whole, start_byte and end_byte of the part."""
    n = F.greatest(F.ceil((F.col("end_byte") - F.col("start_byte")) / F.lit(part_bytes)), F.lit(1)).cast("int")
    rows = windows.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumnsRenamed({"start_byte": "_start", "end_byte": "_end"})
    start = F.col("_start") + F.col("part").cast("long") * part_bytes
    return rows.withColumn("start_byte", start).withColumn("end_byte", F.least(F.col("_end"), start + part_bytes))


def slices_for(windows: DataFrame, manifest: DataFrame, chunks: DataFrame | None, home: str = "",
               chunk_bytes: int = DEFAULT_CHUNK_BYTES,
               bucket_bytes: int = DEFAULT_BUCKET_BYTES, with_text: bool = True,
               text_mode: str = "whole", part_bytes: int = PART_BYTES,
               files: DataFrame | None = None, restarts: DataFrame | None = None) -> DataFrame:
    """Bytes, text and header for resolved windows; one row a window, or one for each ``part`` of a large one.

    ``chunks`` None = read the byte ranges directly from the files (positioned reads for plain files); chunk
    locators = read them from the stored chunk table; a chunk table with bytes = join it.  ``text_mode``:
    ``whole`` decodes each slice once (default); ``per_file`` decodes each file's piece on its own, as a reader
    going file by file does.  Slices in several parts have bytes only, as a character may lie across a border;
    the header stands in part 0.
    """
    # equal requests are answered once and returned as often as they were asked
    window = [c for c in (*WINDOW_COLUMNS, CARRY) if c in windows.columns]
    windows = _in_parts(windows.groupBy(*window).agg(F.count("*").alias("_copies")), part_bytes)
    keys = list(windows.columns)
    # one pass: windows without bytes ride along with NULL pieces, and their slice is empty
    pieces = overlap(windows, manifest, bucket_bytes, keep_empty=True, longest=part_bytes)
    per_file = with_text and text_mode == "per_file"
    if chunks is not None and "bytes" in chunks.columns:
        out = assemble_joined(fetch_chunks(pieces, chunks, chunk_bytes, keep_empty=True), keys, per_file)
    else:
        out = assemble_located(pieces, chunks, keys, chunk_bytes, per_file, files, restarts)
    if per_file:
        out = out.withColumn("bytes", F.aggregate("by_file", F.lit(b""), lambda a, x: F.concat(a, x)))
    ok = F.col("status") == STATUS_OK
    out = out.withColumn("bytes", F.when(ok, F.col("bytes"))).withColumn("slice_hex", F.hex("bytes"))
    if with_text:
        # each file's piece decoded alone turns a character that a file border cuts into replacement characters
        text = F.array_join(F.transform("by_file", lossy_utf8), "") if per_file else lossy_utf8(F.col("bytes"))
        out = out.withColumn("text", F.when(ok & (F.col("_end") - F.col("_start") <= part_bytes), text))
    out = out.drop("start_byte", "end_byte", "by_file").withColumnsRenamed({"_start": "start_byte", "_end": "end_byte"})
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    out = out.withColumn("_copies", copies).drop("_copies")
    header = slice_header(F.col("start_byte"), F.col("end_byte"), F.col("total_bytes"), log_dir(home, F.col("app")),
                          F.col("log_type"))
    refused = F.col("status").isin(STATUS_BAD_REQUEST, STATUS_MISSING_DIR)
    out = out.withColumn("header", F.when(~refused & (F.col("part") == 0), header))
    return out.select(*(c for c in out.columns if c != CARRY), f"{CARRY}.*") if CARRY in out.columns else out


def log_slices(requests: DataFrame, files: DataFrame, chunks: DataFrame | None, home: str = "",
               dirs: DataFrame | None = None, chunk_bytes: int = DEFAULT_CHUNK_BYTES,
               bucket_bytes: int = DEFAULT_BUCKET_BYTES, order: str = "name",
               with_text: bool = True, text_mode: str = "whole", carry: list[str] | None = None,
               part_bytes: int = PART_BYTES, restarts: DataFrame | None = None) -> DataFrame:
    """Answer every byte-range request of ``requests`` in one Spark job.

    ``chunks`` are the chunk locators (``sources.files.read_locators``), a chunk table with bytes, or None to
    read ranges straight from the files in ``files.path`` (no ingestion needed; see ``sources.files.file_table``);
    then ``restarts`` (``sources.gzindex.refresh_restarts``) lets gzip files be unpacked from near the range.
    A slice of more than ``part_bytes`` comes as rows ``part`` 0, 1, ...; nothing is cut off.

    ``carry`` names further columns of ``requests`` to return with each answer.
    """
    req = normalize_requests(requests, carry)
    logs = requested_logs(req)
    manifest = mf.build_manifest(logs, files, order)
    totals = mf.total_length(manifest)
    if dirs is None:
        dirs = mf.log_directories(files)
    windows = resolve_requests(req, totals, dirs)
    return slices_for(windows, manifest, chunks, home, chunk_bytes, bucket_bytes, with_text, text_mode,
                      part_bytes, files, restarts)


def chunks_from_content(files: DataFrame, chunk_bytes: int = DEFAULT_CHUNK_BYTES) -> DataFrame:
    """Chunk table from a file table that already holds uncompressed ``content``."""
    n = F.octet_length("content")
    C = F.lit(chunk_bytes)
    return (files.where(n > 0)
            .select("app", "path", "content",
                    F.explode(F.sequence(F.lit(0).cast("long"),
                                         F.floor((n - 1) / C).cast("long"))).alias("chunk_no"))
            .select("app", "path", "chunk_no", F.least(F.octet_length("content") - F.col("chunk_no") * C, C).cast("long").alias("n_bytes"),
                    F.col("content").substr((F.col("chunk_no") * C + 1).cast("int"), C).alias("bytes")))
