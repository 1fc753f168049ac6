"""Paging over logs: tail, previous page, newly added bytes, the full page plan.

Each function turns a table (logs, cursors, totals) into a request table for
``slices.log_slices`` -- a client's polling loop becomes one bulk job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS_NEW = "new_bytes"
STATUS_NO_NEW = "no_new"
STATUS_TRUNCATED = "truncated"

PAGE_BLOCK = 8192  # page numbers made from one row


def tail_requests(logs: DataFrame, byte_length: int, log_type: str = "stderr") -> DataFrame:
    """The last ``byte_length`` bytes of every (app, pod): no offset."""
    return logs.select(
        F.concat_ws(":", "app", "pod").alias("request_id"), "app", "pod",
        F.lit(log_type).alias("log_type"), F.lit(None).cast("long").alias("offset"),
        F.lit(byte_length).cast("int").alias("byte_length"))


def prev_window(cursors: DataFrame, log_type: str = "stderr") -> DataFrame:
    """Request for the page before a cursor's start ("load more").

    offset = max(start - n, 0); length = min(n, start).
    """
    n = F.col("byte_length").cast("long")
    start = F.col("start_byte").cast("long")
    return cursors.select(
        F.concat_ws(":", "client", "app", "pod").alias("request_id"), "client", "app", "pod",
        F.lit(log_type).alias("log_type"),
        F.greatest(start - n, F.lit(0).cast("long")).alias("offset"),
        F.least(n, start).alias("byte_length"))


def advance_prev(cursors: DataFrame, slices: DataFrame) -> DataFrame:
    """New cursor after a "load more" reply: start moves back, end stays."""
    r = slices.select("request_id", F.col("start_byte").alias("ret_start"),
                      F.col("total_bytes").alias("ret_total"), "status")
    c = cursors.withColumn("request_id", F.concat_ws(":", "client", "app", "pod"))
    j = c.join(r, "request_id", "left")
    ok = F.col("status") == "ok"
    return j.select("client", "app", "pod",
                    F.when(ok, F.col("ret_start")).otherwise(F.col("start_byte")).alias("start_byte"),
                    "end_byte",
                    F.when(ok, F.col("ret_total")).otherwise(F.col("total_bytes")).alias("total_bytes"),
                    "byte_length",
                    (ok & (F.col("ret_start") == 0)).alias("at_start"))


def advance_new(cursors: DataFrame, slices: DataFrame) -> DataFrame:
    """New cursor after a "load new" reply: end and total move to what came back."""
    r = slices.select("request_id", F.col("end_byte").alias("ret_end"),
                      F.col("total_bytes").alias("ret_total"), "status")
    c = cursors.withColumn("request_id", F.concat_ws(":", "client", "app", "pod"))
    j = c.join(r, "request_id", "left")
    grew = (F.col("status") == "ok") & (F.col("ret_total") > F.col("total_bytes"))
    return j.select("client", "app", "pod", "start_byte",
                    F.when(grew, F.col("ret_end")).otherwise(F.col("end_byte")).alias("end_byte"),
                    F.when(grew, F.col("ret_total")).otherwise(F.col("total_bytes")).alias("total_bytes"),
                    "byte_length")


def new_bytes(cursors: DataFrame, totals: DataFrame, log_type: str = "stderr") -> DataFrame:
    """Requests for bytes appended since each cursor's known total ("load new").

    The growth d = total - known total is asked for at an explicit offset (the
    known total), so bytes arriving between two polls are never skipped.
    d = 0 gives no request; a shrunk log (d < 0) is reported as truncated.
    """
    j = cursors.join(totals.select("app", "pod", F.col("total_bytes").alias("now_total")),
                     ["app", "pod"], "left")
    now_total = F.coalesce(F.col("now_total"), F.lit(0).cast("long"))
    d = now_total - F.col("total_bytes")
    status = (F.when(d > 0, F.lit(STATUS_NEW)).when(d == 0, F.lit(STATUS_NO_NEW))
              .otherwise(F.lit(STATUS_TRUNCATED)))
    return j.select(
        F.concat_ws(":", "client", "app", "pod").alias("request_id"), "client", "app", "pod",
        F.lit(log_type).alias("log_type"),
        F.col("total_bytes").cast("long").alias("offset"),
        F.when(d > 0, d).otherwise(F.lit(0)).cast("long").alias("byte_length"),
        status.alias("poll_status"))


def page_plan(totals: DataFrame, byte_length: int) -> DataFrame:
    """Every page of every log, counted back from its end (page 0 = the tail).

    Page i covers [max(total - (i+1)n, 0), total - i*n); the oldest page may
    be short.  Empty logs have no pages.
    """
    n = F.lit(byte_length).cast("long")
    t = F.col("total_bytes").cast("long")
    last = F.floor((t - 1) / n).cast("long")
    # blocks of pages first: no row ever holds the page numbers of a whole log
    step = F.lit(PAGE_BLOCK).cast("long")
    blocks = totals.where(t > 0).select(
        "app", "pod", "total_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / step).cast("long"))).alias("block"))
    pages = blocks.select(
        "app", "pod", "total_bytes",
        F.explode(F.sequence(F.col("block") * step, F.least((F.col("block") + 1) * step - 1, last))).alias("page_no"))
    end = t - F.col("page_no") * n
    return pages.select("app", "pod", "page_no",
                        F.greatest(end - n, F.lit(0).cast("long")).alias("start_byte"),
                        end.alias("end_byte"), "total_bytes")


def page_requests(plan: DataFrame, log_type: str = "stderr") -> DataFrame:
    return plan.select(
        F.concat_ws(":", "app", "pod", F.col("page_no").cast("string")).alias("request_id"),
        "app", "pod", F.lit(log_type).alias("log_type"), F.col("start_byte").alias("offset"),
        (F.col("end_byte") - F.col("start_byte")).alias("byte_length"))
