"""Contents of rolled log files: chunk table, chunk locators, lengths, positioned reads.

Layout: ``<home>/<application name>/<files>``; a file belongs to log
(app, pod) when its name starts with the app and contains ``-<pod>_``.
Files ending in ``.gz`` are gzip streams (several members allowed).

* chunk table -- one pass over each file's bytes, gunzipped as a stream and cut into fixed-size chunks
  (the one Python step); stored in a fixed number of ``app_bucket`` folders.  A file that has grown is read
  from where the last pass ended: its new bytes are chunks of a further segment
* chunk locators -- one row for each run of a file's chunks in a data file: slices join these, and tasks
  read the located rows, so chunk bytes are never shuffled
* lengths -- plain files: listed length; gz files: sum of their chunk sizes

The listing is in ``sources.storage``, the file table in ``sources.filetable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.functions.columns import GZ_SUFFIX
from rollscope.session import reliable_checkpoint  # noqa: F401
from rollscope.sources.storage import (  # noqa: F401  the listing is part of this module's interface
    _listing,
    arrow_location,
    list_home,
    literal_path,
    log_directories,
    readable_home,
    scan_log_files,
)

CHUNK_SCHEMA = T.StructType([
    T.StructField("app", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("bytes", T.BinaryType()),
    # on the last row of a file: was it read on from the known end, and the digest of its stored bytes
    T.StructField("appended", T.BooleanType()),
    T.StructField("digest", T.BinaryType()),
])
BROKEN_CHUNK = -1  # chunk number of the row that marks a file whose bytes cannot be had
NO_CHUNK = -2      # chunk number of the last row of a file without content
DIGEST_BYTES = 1 << 16       # of the beginning and of the end of a file, as a mark of its generation
TOGETHER_CHARS = 3           # paths that differ in so many last characters only (rolled numbers) are chunked by one task
ALONE_BYTES = 1 << 20        # but not files of this size
ROW_GROUP_BYTES = 8 << 20    # of the chunk table: what is read to get at a chunk


def prefix_digest(file, length: int) -> bytes:
    """Digest of the first and the last bytes of the first ``length`` stored bytes."""
    import hashlib
    n = min(DIGEST_BYTES, length)
    return hashlib.blake2b(file.read_at(n, 0) + file.read_at(n, length - n) + str(length).encode(), digest_size=16).digest()


class _Span:
    """Stored bytes [start, end) of an open file as a stream."""

    def __init__(self, file, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def read(self, n: int) -> bytes:
        out = self.file.read(min(n, self.left))
        self.left -= len(out)
        if not out and self.left > 0:
            raise EOFError("the file is shorter than it was listed")
        return out


def _plain_blocks(stream):
    while True:
        block = stream.read(1 << 20)
        if not block:
            return
        yield block


def _path_chunker(chunk_bytes: int, flush_bytes: int = 16 << 20):
    """Reads each path's stored bytes [known, stored_length) as a stream, unpacks and cuts them; holds about ``flush_bytes``.

    ``known`` counts only while the digest of that many bytes is what it was; else the file is another
    generation and is read from its beginning. Bytes that cannot be unpacked, or a file that has shrunk
    since the listing, end with a row ``BROKEN_CHUNK``; a failed read fails the task.
    """
    unpack, plain, opener, digest_of, span = gunzip, _plain_blocks, arrow_location, prefix_digest, _Span
    GZ, BROKEN, NONE, columns = GZ_SUFFIX, BROKEN_CHUNK, NO_CHUNK, CHUNK_SCHEMA.names

    def run(batches):
        import zlib

        import pandas as pd
        for pdf in batches:
            rows, held = [], 0
            for app, path, stored, known, digest in zip(*(pdf[c] for c in ("app", "path", "stored_length", "known", "digest"))):
                fs, p = opener(path)
                with fs.open_input_file(p) as file:
                    k, rest, last, broken = 0, b"", None, file.size() < stored
                    appended = bool(known) and not broken and digest_of(file, int(known)) == bytes(digest)
                    try:
                        stream = span(file, int(known) if appended else 0, int(stored))
                        for block in () if broken else (unpack(stream) if path.endswith(GZ) else plain(stream)):
                            rest += block
                            whole = len(rest) // chunk_bytes
                            for i in range(whole):
                                if last is not None:
                                    rows.append(last)
                                last = (app, path, k, chunk_bytes, rest[i * chunk_bytes:(i + 1) * chunk_bytes], None, None)
                                k += 1
                            held += whole * chunk_bytes
                            rest = rest[whole * chunk_bytes:]
                            if held >= flush_bytes and rows:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                    except (zlib.error, EOFError):
                        broken = True
                    if rest:
                        if last is not None:
                            rows.append(last)
                        last = (app, path, k, len(rest), rest, None, None)
                        held += len(rest)
                    if broken:
                        rows += [last] if last is not None else []
                        last = (app, path, BROKEN, 0, None, None, None)
                    elif stored:
                        last = last or (app, path, NONE, 0, None, None, None)
                        last = (*last[:5], appended, digest_of(file, int(stored)))
                    if last is not None:
                        rows.append(last)
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def _content_chunker(chunk_bytes: int):
    """The same rows from contents that Spark has read; a stored file without content is broken."""
    GZ, BROKEN, NONE, columns, unpack = GZ_SUFFIX, BROKEN_CHUNK, NO_CHUNK, CHUNK_SCHEMA.names, gunzip

    def run(batches):
        import io
        import zlib

        import pandas as pd
        for pdf in batches:
            for app, path, stored, content in zip(*(pdf[c] for c in ("app", "path", "stored_length", "content"))):
                rows, data = [], b""
                try:
                    if content is None and stored:
                        raise EOFError("not read")
                    raw = bytes(content or b"")
                    data = b"".join(unpack(io.BytesIO(raw))) if path.endswith(GZ) else raw
                    end = (app, path, NONE, 0, None, False, None) if stored and not data else None
                except (zlib.error, EOFError):
                    end = (app, path, BROKEN, 0, None, None, None)
                for k in range(0, len(data), chunk_bytes):
                    piece = data[k:k + chunk_bytes]
                    rows.append((app, path, k // chunk_bytes, len(piece), piece, None, None))
                rows += [end] if end else []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)
    return run


def build_chunks(spark: SparkSession, home: str, chunk_bytes: int = 1 << 16,
                 files: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Chunk table (`CHUNK_SCHEMA`) of uncompressed bytes.

    ``files`` (a listing) names exactly the paths to read, whatever their times; by default all files
    of ``home``. With ``known`` and ``digest`` (stored bytes of an earlier pass and their digest), a grown
    file is read from there and its chunks are numbered from there. Only paths are shuffled (into
    ``tasks`` tasks, neighbours of a log together); each task opens its paths and reads them as streams, so a file may be larger than a
    row can be. Where pyarrow cannot open the home, Spark's own reader gives the contents; files that it
    does not read (names starting with ``_`` or ``.``) are marked broken, not left out.
    """
    if files is None:
        files = scan_log_files(spark, home)
    for name, kind in (("known", "long"), ("digest", "binary")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    paths = files.select("app", "path", "stored_length", F.coalesce("known", F.lit(0)).cast("long").alias("known"), "digest")
    if readable_home(spark, home, arrow_location) is None:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal_path(home))
        content = paths.join(read.select("path", "content"), "path", "left")
        return content.select("app", "path", "stored_length", "content").mapInPandas(_content_chunker(chunk_bytes), CHUNK_SCHEMA)
    # files that follow each other in a log are read by one task, so that their chunks stand together in a data file
    # and a slice does not open one for each of its files; large files are dealt one by one
    together = F.regexp_replace(F.col("path"), rf".{{0,{TOGETHER_CHARS}}}(\.gz)?$", "")
    alone = F.when(F.col("stored_length") >= ALONE_BYTES, F.xxhash64("path"))
    return paths.repartition(tasks or spark.sparkContext.defaultParallelism, together, alone).mapInPandas(
        _path_chunker(chunk_bytes), CHUNK_SCHEMA)


def chunk_sums(chunks: DataFrame) -> DataFrame:
    """(path, n_bytes, read_error, appended, digest) of each file with a row in the chunk table; no bytes are read."""
    return chunks.groupBy("path").agg(
        F.sum("n_bytes").alias("n_bytes"), F.bool_or(F.col("chunk_no") == BROKEN_CHUNK).alias("read_error"),
        F.coalesce(F.bool_or("appended"), F.lit(False)).alias("appended"), F.max("digest").alias("digest"))


def uncompressed_length(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with ``length`` = bytes after gunzip (gz) or the stored length (plain), and ``read_error``."""
    sums = chunk_sums(chunks).select("path", F.col("n_bytes").alias("_n"), F.col("read_error").alias("_broken"))
    gz = F.col("file_name").endswith(GZ_SUFFIX)
    j = files.join(sums, "path", "left")
    return (j.withColumn("length", F.when(gz, F.coalesce(F.col("_n"), F.lit(0).cast("long")))
                         .otherwise(F.col("stored_length")))
            .withColumn("read_error", F.coalesce("_broken", F.lit(False))).drop("_n", "_broken"))


CHUNK_BUCKETS = 32


def app_bucket(app, buckets: int = CHUNK_BUCKETS):
    """Storage bucket of an application: a fixed number of folders however many apps exist."""
    return F.pmod(F.xxhash64(app), F.lit(buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", buckets: int = CHUNK_BUCKETS) -> None:
    """Chunk table as Parquet partitioned by ``app_bucket``, rows sorted by (path, chunk_no).

    Bucketing the folders (not one folder per application) keeps the folder
    count fixed as applications grow; slice jobs join on the bucket too, so
    dynamic partition pruning skips buckets no request touches.  A local sort
    only: the chunker already emits each file's chunks together.  Row groups are
    small, as a task that wants one chunk reads the row group that holds it.
    """
    (chunks.withColumn("app_bucket", app_bucket(F.col("app"), buckets))
     .sortWithinPartitions("app_bucket", "path", "chunk_no")
     .write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("app_bucket").parquet(path))


def locate_chunks(stored: DataFrame) -> DataFrame:
    """(path, data_file, first_chunk, last_chunk, shift): chunk ``n`` of the path is row ``n + shift`` of the data file.

    One row for each run of a path's chunks, from the stored chunk table's row positions; no bytes are read.
    """
    rows = stored.where("chunk_no >= 0").select(
        "path", "chunk_no", F.col("_metadata.file_path").alias("data_file"),
        (F.col("_metadata.row_index") - F.col("chunk_no")).alias("shift"))
    return rows.groupBy("path", "data_file", "shift").agg(
        F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk")).select(
        "path", "data_file", "first_chunk", "last_chunk", "shift")



def gunzip(raw, block: int = 1 << 20):
    """Decompressed pieces of a gzip stream (several members allowed), read block by block.

    A stream that ends within a member raises EOFError: a cut file is not taken for a whole one.
    """
    import zlib
    d, within = zlib.decompressobj(16 + zlib.MAX_WBITS), False
    while True:
        buf = raw.read(block)
        if not buf:
            break
        buf = bytes(buf)
        while buf:
            if not within:
                buf = buf.lstrip(b"\0")  # padding between members
                if not buf:
                    break
            within = True
            out = d.decompress(buf)
            if out:
                yield out
            buf = d.unused_data
            if d.eof:
                d, within = zlib.decompressobj(16 + zlib.MAX_WBITS), False
    if within:
        raise EOFError("gzip stream ends within a member")


def _length_counter(batch_bytes: int = 1 << 20):
    gz_stream, opener = gunzip, arrow_location

    def run(batches):
        import zlib

        import pandas as pd

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                fs, p = opener(path)
                with fs.open_input_stream(p, compression=None) as raw:
                    try:
                        out.append(sum(len(b) for b in gz_stream(raw, batch_bytes)))
                    except (zlib.error, EOFError):
                        out.append(-1)
            yield pd.DataFrame({"path": pdf["path"], "_gz_len": out})
    return run


def file_table(spark: SparkSession, home: str, snapshot: DataFrame | None = None,
               restarts: DataFrame | None = None) -> DataFrame:
    """File table without a chunk table, for direct range reads.

    Plain files take their listed length (no byte is read); gz files are
    streamed once in tasks to count their uncompressed bytes, or take their length from the restart index
    (``gzindex.refresh_restarts``), which must then be as new as the listing.
    """
    listing = scan_log_files(spark, home, snapshot)
    gz = listing.where(F.col("file_name").endswith(GZ_SUFFIX))
    if restarts is None:
        sizes = gz.select("path").mapInPandas(_length_counter(), "path string, _gz_len long")
    else:
        known = restarts.where("length IS NOT NULL").groupBy("path", "stored_length", "modified").agg(F.max("length").alias("_gz_len"))
        sizes = gz.join(known, ["path", "stored_length", "modified"], "left").select("path", F.coalesce("_gz_len", F.lit(-1)).alias("_gz_len"))
    j = listing.join(sizes, "path", "left")
    length = F.when(F.col("file_name").endswith(GZ_SUFFIX), F.greatest("_gz_len", F.lit(0).cast("long")))
    return (j.withColumn("length", length.otherwise(F.col("stored_length")))
            .withColumn("read_error", F.coalesce(F.col("_gz_len") < 0, F.lit(False))).drop("_gz_len"))


class _DataFiles:
    """Rows of chunk data files; keeps the last file and row group, as units come in the order of their places."""

    def __init__(self):
        self.place, self.file, self.starts, self.group, self.rows = None, None, [], None, None

    def joined(self, place: str, first: int, count: int) -> bytes:
        """The bytes of ``count`` rows from row ``first`` on."""
        import bisect
        from urllib.parse import unquote

        import pyarrow.parquet as pq
        if place != self.place:
            fs, p = arrow_location(unquote(place))
            self.file, self.place, self.group = pq.ParquetFile(fs.open_input_file(p)), place, None
            self.starts, at = [], 0
            for g in range(self.file.metadata.num_row_groups):
                self.starts.append(at)
                at += self.file.metadata.row_group(g).num_rows
        out = []
        while count > 0:
            group = bisect.bisect_right(self.starts, first) - 1
            if group != self.group:
                self.rows, self.group = self.file.read_row_group(group, columns=["bytes"]).column("bytes"), group
            some = self.rows.slice(first - self.starts[group], count).to_pylist()
            if not some:
                raise OSError(f"{place}: no row {first}")
            out += some
            first, count = first + len(some), count - len(some)
        return b"".join(out)


def _chunk_piece(data: _DataFiles, piece: dict, chunk_bytes: int) -> bytes:
    """Bytes [lo, hi) counted from the beginning of chunk row ``row``."""
    lo, hi = piece["lo"], piece["hi"]
    first, last = lo // chunk_bytes, (hi - 1) // chunk_bytes
    got = data.joined(piece["place"], piece["row"] + first, last - first + 1)
    out = got[lo - first * chunk_bytes:hi - first * chunk_bytes]
    if len(out) != hi - lo:
        raise OSError(f"{piece['place']}: {len(out)} of {hi - lo} bytes from row {piece['row']}")
    return out


def _file_piece(path: str, lo: int, hi: int) -> bytes:
    """Uncompressed bytes [lo, hi) of a file: one positioned read of a plain file, a streamed skip in a gzip file."""
    fs, p = arrow_location(path)
    if not path.endswith(GZ_SUFFIX):
        with fs.open_input_file(p) as f:
            piece = f.read_at(hi - lo, lo)
        if len(piece) < hi - lo:
            raise OSError(f"{path}: {len(piece)} of {hi - lo} bytes at {lo}; the file has shrunk")
        return piece
    got, pos = [], 0
    with fs.open_input_stream(p, compression=None) as raw:
        for b in gunzip(raw):
            end = pos + len(b)
            if end > lo:
                got.append(b[max(lo - pos, 0):hi - pos])
            pos = end
            if pos >= hi:
                break
    return b"".join(got)


def _point_piece(data: _DataFiles, piece: dict) -> bytes:
    """Uncompressed bytes [lo, hi) of a gzip file from a point of its restart index."""
    from rollscope.sources.gzindex import read_from_point
    point = piece["restart"]
    window = None if point["place"] is None else data.joined(point["place"], point["row"], 1)
    return read_from_point(piece["place"], piece["lo"], piece["hi"], point["stored_at"], point["raw_at"], window)


def _unit_reader(chunk_bytes: int, per_file: bool, flush_bytes: int = 32 << 20):
    data_files, chunk_piece, file_piece, point_piece = _DataFiles, _chunk_piece, _file_piece, _point_piece

    def run(batches):
        import pyarrow as pa
        data = data_files()
        for batch in batches:
            at = batch.schema.get_field_index("pieces")
            columns, names = [c for i, c in enumerate(batch.columns) if i != at], [n for n in batch.schema.names if n != "pieces"]
            start, held, out = 0, 0, []

            def take(end):
                made = pa.array(out, pa.list_(pa.binary()) if per_file else pa.binary())
                return pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in columns] + [made],
                                                  [*names, "by_file" if per_file else "bytes"])

            for i, pieces in enumerate(batch.column(at)):
                by_file, ranks = [], []
                for piece in pieces.as_py():
                    if piece["row"] is not None:
                        got = chunk_piece(data, piece, chunk_bytes)
                    elif piece.get("restart"):
                        got = point_piece(data, piece)
                    else:
                        got = file_piece(piece["place"], piece["lo"], piece["hi"])
                    held += len(got)
                    if ranks[-1:] == [piece["file_rank"]]:
                        by_file[-1].append(got)
                    else:
                        ranks.append(piece["file_rank"])
                        by_file.append([got])
                by_file = [b"".join(x) for x in by_file]
                out.append(by_file if per_file else b"".join(by_file))
                if held >= flush_bytes:
                    yield take(i + 1)
                    start, held, out = i + 1, 0, []
            if out:
                yield take(batch.num_rows)
    return run


def read_units(units: DataFrame, chunk_bytes: int, per_file: bool = False) -> DataFrame:
    """``units`` with ``pieces`` replaced by their ``bytes`` in order (``per_file``: ``by_file``, one value a file).

    A piece names rows of a chunk data file (``place``, ``row``) or, with ``row`` null, a byte range of a log
    file. Units are dealt by their first place, so that a data file's row groups are read by few tasks; a
    place that many ask for is split by the adaptive rebalance. Only places and ranges are shuffled.
    """
    first = F.get("pieces", F.lit(0))
    placed = units.withColumn("_place", first["place"]).withColumn("_row", first["row"]).hint("rebalance", "_place")
    placed = placed.sortWithinPartitions("_place", "_row").drop("_place", "_row")
    schema = T.StructType([f for f in units.schema.fields if f.name != "pieces"]
                          + [T.StructField("by_file", T.ArrayType(T.BinaryType())) if per_file else T.StructField("bytes", T.BinaryType())])
    return placed.mapInArrow(_unit_reader(chunk_bytes, per_file), schema)


from rollscope.sources.filetable import (  # noqa: E402, F401  the file table is part of this module's interface
    FILE_TABLE_SCHEMA,
    drop_superseded,
    read_chunks,
    read_file_table,
    read_locators,
    refresh_file_table,
)
