"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: these must equal the observable behaviour being matched ---
# default slice size when a request gives no byte length
DEFAULT_BYTE_LENGTH = 102400
# suffix that marks a gzip-compressed rolled file (case-sensitive)
GZ_SUFFIX = ".gz"
# pod name of the driver; every other executor id becomes "exec-<id>"
DRIVER_POD = "driver"
EXECUTOR_POD_PREFIX = "exec-"
# the single key of a rewritten executor log map, and the log type of its link
LOG_LINK_KEY = "logs"
LOG_LINK_TYPE = "stderr"
# text put in front of a slice: start, end, total, directory, log type
HEADER_FORMAT = "==== Bytes %d-%d of %d of %s%s ====\n"
# path and query parameters of an executor log link
LOG_PAGE_PATH = "/logPage/?appId="
LOG_PAGE_POD_PARAM = "&podId="
LOG_PAGE_TYPE_PARAM = "&logType="
# -----------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scala_str(col: Column | str) -> Column:
    """String concatenation on the JVM side of the original renders NULL as 'null'."""
    return F.coalesce(_c(col).cast("string"), F.lit("null"))


def strip_gz(name: Column | str) -> Column:
    """File name without one trailing '.gz' (the rolled-file sort key)."""
    return F.regexp_replace(_c(name), r"\.gz$", "")


def is_gz(name: Column | str) -> Column:
    return _c(name).endswith(GZ_SUFFIX)


def resolve_window(offset: Column | str, byte_length: Column | str,
                   total: Column | str) -> tuple[Column, Column]:
    """(start, end) of a request on a log of ``total`` bytes.

    No offset means "the last ``byte_length`` bytes"; the start is clamped to
    [0, total] and the end is ``min(start + byte_length, total)``.  A negative
    length yields end < start, which callers report as an error.
    """
    total = _c(total).cast("long")
    n = _c(byte_length).cast("long")
    off = F.coalesce(_c(offset).cast("long"), total - n)
    start = F.when(off < 0, F.lit(0).cast("long")).when(off > total, total).otherwise(off)
    end = F.least(start + n, total)
    return start, end


def log_dir(home: str, app: Column | str) -> Column:
    """Directory of one application's logs: ``<home>/<app>/``."""
    return F.concat(F.lit(home), F.lit("/"), scala_str(app), F.lit("/"))


def slice_header(start: Column | str, end: Column | str, total: Column | str,
                 directory: Column | str, log_type: Column | str) -> Column:
    return F.format_string(HEADER_FORMAT, _c(start), _c(end), _c(total),
                           scala_str(directory), scala_str(log_type))


def parse_header(text: Column | str) -> Column:
    """Start, end and total read back from a slice header.

    Takes the first three digit runs of the first line, as a client does.
    """
    first_line = F.substring_index(_c(text), "\n", 1)
    runs = F.regexp_extract_all(first_line, F.lit(r"(\d+)"), 1)
    return F.struct(
        F.get(runs, 0).cast("long").alias("start_byte"),
        F.get(runs, 1).cast("long").alias("end_byte"),
        F.get(runs, 2).cast("long").alias("total_bytes"),
    )


def lossy_utf8(raw: Column | str) -> Column:
    """Bytes to text; malformed sequences become U+FFFD instead of failing."""
    return F.make_valid_utf8(_c(raw).cast("string"))


def pod_id(executor_id: Column | str) -> Column:
    e = _c(executor_id)
    return F.when(e == F.lit(DRIVER_POD), e).otherwise(
        F.concat(F.lit(EXECUTOR_POD_PREFIX), scala_str(e)))


def log_url(app_name: Column | str, pod: Column | str, proxy_base: str = "",
            encode: bool = False) -> Column:
    """Link of an executor's log page: app name (not id) and pod, no encoding by default."""
    name = scala_str(app_name)
    p = scala_str(pod)
    if encode:
        name, p = F.url_encode(name), F.url_encode(p)
    return F.concat(F.lit(proxy_base), F.lit(LOG_PAGE_PATH), name, F.lit(LOG_PAGE_POD_PARAM), p,
                    F.lit(LOG_PAGE_TYPE_PARAM + LOG_LINK_TYPE))


def latest_attempt(attempts: Column | str, requested: Column | str | None = None) -> Column:
    """Requested attempt id, else the id of the newest attempt (element 0), else NULL."""
    head = F.get(_c(attempts), 0).getField("attemptId")
    if requested is None:
        return head
    return F.coalesce(_c(requested), head)


def java_split(text: str | None, sep: str = ",") -> list[str]:
    """Split a setting the way the JVM's ``String.split`` does.

    ``""`` gives ``[""]``, ``","`` gives ``[]``, trailing empty pieces are
    dropped, leading ones kept and nothing is trimmed.
    """
    if text is None:
        return []
    if sep not in text:
        return [text]
    parts = text.split(sep)
    while parts and parts[-1] == "":
        parts.pop()
    return parts
