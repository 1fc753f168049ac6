"""Paging cursors as streaming state: what a polling client asks for, decided once per growth of a log.

Two streams meet in keyed state (``transformWithState``): totals of logs as the ingestion writes them
(`rolled.write_totals`), and events of clients (``CLIENT_EVENTS``):

* ``open``: the client shows [start_byte, end_byte) of a log that had total_bytes
* ``more``: it wants the ``byte_length`` bytes before what it shows
* ``close``: it is forgotten

A log's clients are dealt to ``shards`` keys by name, so a log that very many follow is no single key.  A first
state by log keeps its newest total and the shards in which a client has opened it, and hands a total to these alone;
a second one by shard keeps that total and each client's cursor.  Output rows are requests for ``slices.log_slices``,
as `paging.new_bytes` and `paging.prev_window` make them from tables: growth at an explicit offset, so that nothing is
skipped or sent twice, ``truncated`` when a log has shrunk, and earlier pages.

Totals carry the number of their file-table delta: repeated or late ones change nothing.  Events of one client are
taken in the order of ``seq``; repeated ones (same or lower ``seq``) change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollscope.operators.paging import STATUS_NEW, STATUS_TRUNCATED
from rollscope.operators.slices import log_slices
from rollscope.sources import filetable as ft

STATUS_MORE = "more"
OPEN, MORE, CLOSE, TOTAL = "open", "more", "close", "total"
SHARDS = 8            # keys of a log
ROWS_OUT = 10_000     # of one output frame
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CLIENT_EVENTS = ("seq long, kind string, client string, app string, pod string, start_byte long, end_byte long, "
                 "total_bytes long, byte_length long")
TOTALS = "app string, pod string, total_bytes long, seq long"
REQUESTS = ("request_id string, client string, app string, pod string, log_type string, offset long, byte_length long, "
            "poll_status string")
_CURSOR = "seq long, start_byte long, end_byte long, total_bytes long"
_NAMES = [f.strip().split(" ")[0] for f in REQUESTS.split(",")]
_HANDED = "app string, pod string, shard int, seq long, total_bytes long"
_NO_SHARD = -1        # in rows that bring a total


class TotalsProcessor(StatefulProcessor):
    """State of one (app, pod): its newest total (number null: none yet) and the shards that clients opened it in.

    A shard gets the newest total when a client first opens the log in it, then each newer one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "seq long, total_bytes long, shards array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        app, pod = key
        stored = tuple(self.log.get()) if self.log.exists() else (None, None, [])
        newest, had = (stored[0], stored[1]), set(stored[2])
        asked = set(had)
        for row in rows:
            if row.shard != _NO_SHARD:
                asked.add(row.shard)
            elif newest[0] is None or row.seq > newest[0]:
                newest = (row.seq, row.total_bytes)
        grown = newest != (stored[0], stored[1])
        if grown or asked != had:
            self.log.update((*newest, sorted(asked)))
        if newest[0] is not None:
            for shard in sorted(asked if grown else asked - had):
                yield Row(app=app, pod=pod, shard=shard, seq=newest[0], total_bytes=newest[1])

    def close(self) -> None:
        """Nothing is held outside the state."""


class CursorProcessor(StatefulProcessor):
    """State of one (app, pod, shard): ``log`` (newest total and its number), ``cursors`` (client -> cursor)."""

    def __init__(self, log_type: str):
        self.log_type = log_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "seq long, total_bytes long")
        self.cursors = handle.getMapState("cursors", "client string", _CURSOR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        app, pod, _ = key
        events, newest = {}, self.log.get() if self.log.exists() else None
        known = newest
        for frame in rows:
            for e in frame.itertuples(index=False):
                if e.kind == TOTAL:
                    if newest is None or int(e.seq) > newest[0]:
                        newest = (int(e.seq), int(e.total_bytes))
                else:
                    events.setdefault(e.client, []).append(e)
        grown = newest != known
        if grown:
            self.log.update(newest)
        out = []
        for client in sorted(events):
            out += self._client(app, pod, client, sorted(events[client], key=lambda e: int(e.seq)), newest, grown)
        if grown:  # the cursors of this shard; those with events are up to date
            for (client,), cursor in list(self.cursors.iterator()):
                if client not in events:
                    requests, after = self._compare(app, pod, client, tuple(cursor), newest)
                    if after != tuple(cursor):
                        self.cursors.updateValue((client,), after)
                    out += requests
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=_NAMES)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def _row(self, app, pod, client, offset, length, status):
        return ":".join((client, app, pod)), client, app, pod, self.log_type, offset, length, status

    def _client(self, app, pod, client, events, newest, grown) -> list:
        cursor = stored = tuple(self.cursors.getValue((client,))) if self.cursors.containsKey((client,)) else None
        out, opened = [], False
        for e in events:
            seq = int(e.seq)
            if cursor is not None and seq <= cursor[0]:
                continue
            if e.kind == OPEN:
                cursor, opened = (seq, int(e.start_byte), int(e.end_byte), int(e.total_bytes)), True
            elif e.kind == CLOSE:
                cursor = None
            elif cursor is not None:
                start = max(cursor[1] - int(e.byte_length), 0)
                if start < cursor[1]:
                    out.append(self._row(app, pod, client, start, cursor[1] - start, STATUS_MORE))
                cursor = (seq, start, *cursor[2:])
        if cursor is None:
            if stored is not None:
                self.cursors.removeKey((client,))
            return out
        requests, cursor = self._compare(app, pod, client, cursor, newest, opened or grown)
        if cursor != stored:
            self.cursors.updateValue((client,), cursor)
        return out + requests

    def _compare(self, app, pod, client, cursor, newest, report=True) -> tuple[list, tuple]:
        """The request for what the log has grown by, and the cursor then; a shrunk log leaves it as it is."""
        if newest is None or newest[1] == cursor[3]:
            return [], cursor
        if newest[1] < cursor[3]:
            return [self._row(app, pod, client, cursor[3], 0, STATUS_TRUNCATED)] if report else [], cursor
        return ([self._row(app, pod, client, cursor[3], newest[1] - cursor[3], STATUS_NEW)],
                (cursor[0], cursor[1], newest[1], newest[1]))

    def close(self) -> None:
        """Nothing is held outside the state."""


def totals_stream(spark: SparkSession, out: str) -> DataFrame:
    """Totals as the ingestion into ``out`` writes them."""
    return spark.readStream.schema(TOTALS).parquet(f"{out.rstrip('/')}/totals")


def poll_requests(totals: DataFrame, clients: DataFrame, log_type: str = "stderr", shards: int = SHARDS) -> DataFrame:
    """Requests (streaming) from streams of totals (app, pod, total_bytes, seq) and of client events (`CLIENT_EVENTS`).

    Rows without app, pod or seq, totals without a number, and client rows without a client or with an unknown kind
    are left out; missing positions count as 0. ``shards`` stays the same for the life of a checkpoint.  Checkpoints
    from before the state by log existed cannot be continued: start a new one.
    """
    spark = totals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    zero = F.lit(0).cast("long")
    whole = "app IS NOT NULL AND pod IS NOT NULL AND seq IS NOT NULL"
    position = [F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
                for c in ("start_byte", "end_byte", "total_bytes", "byte_length")]
    c = clients.where(F.col("client").isNotNull() & F.col("kind").isin(OPEN, MORE, CLOSE)).select(
        "seq", "kind", "client", "app", "pod", *position, F.pmod(F.xxhash64("client"), F.lit(shards)).cast("int").alias("shard"))
    c = c.where(whole)
    # a cursor begins with an open: only shards with one want the log's totals
    asked = c.where(F.col("kind") == OPEN).select("app", "pod", "shard", zero.alias("seq"), zero.alias("total_bytes"))
    t = totals.where("total_bytes IS NOT NULL").where(whole).select(
        "app", "pod", F.lit(_NO_SHARD).alias("shard"), "seq", "total_bytes")
    handed = t.unionByName(asked).groupBy("app", "pod").transformWithState(
        statefulProcessor=TotalsProcessor(), outputStructType=T.StructType.fromDDL(_HANDED), outputMode="append", timeMode="none")
    handed = handed.select("seq", F.lit(TOTAL).alias("kind"), F.lit(None).cast("string").alias("client"), "app", "pod",
                           *(zero.alias(x) for x in ("start_byte", "end_byte")), "total_bytes", zero.alias("byte_length"), "shard")
    return handed.unionByName(c).groupBy("app", "pod", "shard").transformWithStateInPandas(
        statefulProcessor=CursorProcessor(log_type), outputStructType=T.StructType.fromDDL(REQUESTS),
        outputMode="append", timeMode="none")


def answer_polls(spark: SparkSession, clients: DataFrame, out: str, answers: str, checkpoint: str, chunk_bytes: int = 1 << 16,
                 home: str = "", shards: int = SHARDS, available_now: bool = True, processing_time: str | None = None):
    """Answer clients from the tables that `rolled.stream_rolled_files` keeps in ``out``.

    Each trigger's requests become slices by one job, written to ``<answers>/batch_id=<n>`` with overwrite: a
    trigger that is run again writes the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        files, at = ft.read_file_table(s, f"{out}/files"), ft.read_locators(s, f"{out}/chunks")
        if files is None or at is None:
            return
        # a client may have an earlier page and new bytes in one trigger: two requests
        named = batch.withColumn("request_id", F.concat_ws(":", "poll_status", "request_id"))
        replies = log_slices(named, files, at, home, chunk_bytes=chunk_bytes, carry=["client", "poll_status"])
        replies.write.mode("overwrite").parquet(f"{answers.rstrip('/')}/batch_id={batch_id}")

    w = (poll_requests(totals_stream(spark, out), clients, shards=shards).writeStream.foreachBatch(write)
         .outputMode("append").option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
