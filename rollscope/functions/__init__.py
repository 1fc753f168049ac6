"""Scalar column functions (all JVM-side built-in expressions)."""

from rollscope.functions.columns import (
    DEFAULT_BYTE_LENGTH,
    java_split,
    latest_attempt,
    log_dir,
    log_url,
    lossy_utf8,
    parse_header,
    pod_id,
    resolve_window,
    slice_header,
    strip_gz,
)

__all__ = [
    "DEFAULT_BYTE_LENGTH",
    "java_split",
    "latest_attempt",
    "log_dir",
    "log_url",
    "lossy_utf8",
    "parse_header",
    "pod_id",
    "resolve_window",
    "slice_header",
    "strip_gz",
]
