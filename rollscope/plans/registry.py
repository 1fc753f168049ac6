"""Registered queries: one Spark plan per operator / composite, plus its SQL oracle.

Each query takes ``(spark, sf_dir)``, builds its inputs from the driver tables
through ``rollscope.sources.fixtures`` and returns a DataFrame without
collecting.  Nested values are flattened so results compare row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscope.functions import columns as fc
from rollscope.operators import manifest as mf
from rollscope.operators import slices as sl
from rollscope.plans import oracle_sql as osql
from rollscope.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------- log inputs

def _files(spark, sf_dir):
    return fx.log_files(spark, sf_dir)


def _requests(spark, sf_dir):
    return fx.log_requests(spark, sf_dir)


def _manifest(spark, sf_dir):
    req = sl.normalize_requests(_requests(spark, sf_dir))
    return mf.build_manifest(sl.requested_logs(req), _files(spark, sf_dir))


def _windows(spark, sf_dir, requests=None):
    files = _files(spark, sf_dir)
    req = sl.normalize_requests(requests if requests is not None else _requests(spark, sf_dir))
    manifest = mf.build_manifest(sl.requested_logs(req), files)
    return sl.resolve_requests(req, mf.total_length(manifest), mf.log_directories(files)), manifest


def _slices(spark, sf_dir, requests=None, with_text=False, carry=None):
    files = _files(spark, sf_dir)
    req = requests if requests is not None else _requests(spark, sf_dir)
    return sl.log_slices(req, files, fx.chunk_locators(spark, sf_dir), home=fx.LOG_HOME, chunk_bytes=fx.CHUNK_BYTES,
                         bucket_bytes=fx.BUCKET_BYTES, with_text=with_text, carry=carry)


SLICE_COLS = ["request_id", "app", "pod", "start_byte", "end_byte", "total_bytes", "status",
              "slice_hex"]


# ------------------------------------------------------------- projections

@register("strip_gz", osql.with_ctes(osql.LOG_FILES) + """
SELECT path, file_name, regexp_replace(file_name, '\\.gz$', '') AS sort_key FROM log_files_p""")
def q_strip_gz(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "file_name", fc.strip_gz("file_name").alias("sort_key"))


@register("byte_window", osql.LOG_BASE + """
SELECT request_id, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte,
       tot AS total_bytes FROM win""")
def q_byte_window(spark, sf_dir):
    files = _files(spark, sf_dir)
    req = sl.normalize_requests(_requests(spark, sf_dir))
    totals = mf.total_length(mf.build_manifest(sl.requested_logs(req), files))
    j = req.join(totals, ["app", "pod"], "left")
    total = F.coalesce(F.col("total_bytes"), F.lit(0).cast("long"))
    start, end = fc.resolve_window(F.col("offset"), F.col("byte_length"), total)
    return j.select("request_id", start.alias("start_byte"), end.alias("end_byte"),
                    total.alias("total_bytes"))


@register("log_dir", osql.LOG_BASE + """
SELECT request_id, 'logs/' || app || '/' AS log_dir, status FROM winr""")
def q_log_dir(spark, sf_dir):
    w, _ = _windows(spark, sf_dir)
    return w.select("request_id", fc.log_dir(fx.LOG_HOME, F.col("app")).alias("log_dir"), "status")


@register("slice_status", osql.LOG_BASE + """
SELECT request_id, status, start_byte, end_byte, total_bytes FROM winr""")
def q_slice_status(spark, sf_dir):
    w, _ = _windows(spark, sf_dir)
    return w.select("request_id", "status", "start_byte", "end_byte", "total_bytes")


@register("slice_header", osql.LOG_BASE + f"""
SELECT request_id, {osql.HEADER} AS header FROM winr""")
def q_slice_header(spark, sf_dir):
    return _slices(spark, sf_dir).select("request_id", "header")


@register("slice_header_parse", osql.LOG_BASE + """
SELECT request_id, start_byte, end_byte, total_bytes FROM winr""")
def q_slice_header_parse(spark, sf_dir):
    s = _slices(spark, sf_dir, with_text=True)
    reply = F.concat(F.col("header"), F.coalesce(F.col("text"), F.lit("")))
    return (s.select("request_id", fc.parse_header(reply).alias("p"))
            .select("request_id", "p.start_byte", "p.end_byte", "p.total_bytes"))


# slices of valid text are broken at their ends only: continuation bytes in front, an unfinished sequence behind
@register("lossy_utf8", osql.LOG_BASE + """
, ends AS (SELECT request_id, slice_hex, regexp_extract(slice_hex, '^((?:[89AB][0-9A-F])*)', 1) AS lead FROM winr),
rest AS (SELECT *, substr(slice_hex, length(lead) + 1) AS body FROM ends),
cut AS (SELECT *, regexp_extract(body,
  '^(?:[0-9A-F]{2})*?((?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2}))$', 1) AS trail FROM rest)
SELECT request_id, slice_hex,
  CASE WHEN slice_hex IS NOT NULL THEN repeat(chr(65533), CAST(length(lead) / 2 AS BIGINT))
    || decode(unhex(substr(body, 1, length(body) - length(trail))))
    || CASE WHEN trail <> '' THEN chr(65533) ELSE '' END END AS text
FROM cut""")
def q_lossy_utf8(spark, sf_dir):
    return _slices(spark, sf_dir, with_text=True).select("request_id", "slice_hex", "text")


# --------------------------------------------------------- filters and joins

@register("log_file_match", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST) + """
SELECT app, pod, file_name FROM matched""")
def q_log_file_match(spark, sf_dir):
    files = _files(spark, sf_dir)
    logs = files.select("app", "pod").distinct()
    return mf.match_files(logs, files).select("app", "pod", "file_name")


@register("requests_to_files", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.REQUESTS, osql.MANIFEST) + """
SELECT r.request_id, m.file_name FROM requests r LEFT JOIN matched m ON m.app = r.app AND m.pod = r.pod""")
def q_requests_to_files(spark, sf_dir):
    req = sl.normalize_requests(_requests(spark, sf_dir))
    matched = mf.match_files(sl.requested_logs(req), _files(spark, sf_dir))
    return req.join(matched, ["app", "pod"], "left").select("request_id", "file_name")


@register("slice_overlap", osql.LOG_BASE + """
SELECT w.request_id, m.path, m.file_rank,
       greatest(w.start_byte, m.file_start) - m.file_start AS local_start,
       least(w.end_byte, m.file_end) - m.file_start AS local_end
FROM winr w JOIN manifest_x m ON m.app = w.app AND m.pod = w.pod
WHERE w.status = 'ok' AND greatest(w.start_byte, m.file_start) < least(w.end_byte, m.file_end)""")
def q_slice_overlap(spark, sf_dir):
    w, manifest = _windows(spark, sf_dir)
    return sl.overlap(w, manifest, fx.BUCKET_BYTES).select("request_id", "path", "file_rank", "local_start", "local_end")


@register("slice_chunks", osql.LOG_BASE + f"""
, ov AS (
  SELECT w.request_id, m.path, m.file_rank, m.content,
         greatest(w.start_byte, m.file_start) - m.file_start AS ls,
         least(w.end_byte, m.file_end) - m.file_start AS le
  FROM winr w JOIN manifest_x m ON m.app = w.app AND m.pod = w.pod
  WHERE w.status = 'ok' AND greatest(w.start_byte, m.file_start) < least(w.end_byte, m.file_end)),
ck AS (
  SELECT ov.*, c AS chunk_no FROM ov,
  LATERAL (SELECT unnest(range(CAST(floor(ls / {fx.CHUNK_BYTES}) AS BIGINT),
                               CAST(floor((le - 1) / {fx.CHUNK_BYTES}) AS BIGINT) + 1)) AS c))
SELECT request_id, path, chunk_no,
       substr(hex(content), CAST(2 * greatest(ls, chunk_no * {fx.CHUNK_BYTES}) + 1 AS BIGINT),
              CAST(2 * (least(le, (chunk_no + 1) * {fx.CHUNK_BYTES}) - greatest(ls, chunk_no * {fx.CHUNK_BYTES})) AS BIGINT))
         AS piece_hex
FROM ck""")
def q_slice_chunks(spark, sf_dir):
    w, manifest = _windows(spark, sf_dir)
    pieces = sl.overlap(w, manifest, fx.BUCKET_BYTES)
    return sl.fetch_located(pieces, fx.chunk_locators(spark, sf_dir), fx.CHUNK_BYTES).select(
        "request_id", "path", "chunk_no", F.hex("piece").alias("piece_hex"))


# -------------------------------------------------- aggregations and windows

@register("log_total_length", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST) + """
SELECT app, pod, total_bytes FROM log_hex""")
def q_log_total_length(spark, sf_dir):
    return mf.total_length(_manifest(spark, sf_dir))


@register("file_rank", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST) + """
SELECT app, pod, file_name, CAST(file_rank AS INTEGER) AS file_rank FROM manifest_x""")
def q_file_rank(spark, sf_dir):
    files = _files(spark, sf_dir)
    logs = files.select("app", "pod").distinct()
    return mf.with_rank_offsets(mf.match_files(logs, files)).select("app", "pod", "file_name", "file_rank")


@register("file_offsets", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST) + """
SELECT app, pod, file_name, CAST(file_rank AS INTEGER) AS file_rank, file_start, file_end FROM manifest_x""")
def q_file_offsets(spark, sf_dir):
    return _manifest(spark, sf_dir).select("app", "pod", "file_name", "file_rank", "file_start", "file_end")


@register("slice_assemble", osql.LOG_BASE + """
SELECT request_id, slice_hex FROM winr WHERE status = 'ok' AND end_byte > start_byte""")
def q_slice_assemble(spark, sf_dir):
    w, manifest = _windows(spark, sf_dir)
    pieces = sl.overlap(w, manifest, fx.BUCKET_BYTES)
    out = sl.assemble_located(pieces, fx.chunk_locators(spark, sf_dir), ["request_id"], fx.CHUNK_BYTES)
    return out.select("request_id", F.hex("bytes").alias("slice_hex"))


# ------------------------------------------------------------ sorts / limits

@register("rolled_sort", osql.with_ctes(osql.LOG_FILES) + """
SELECT app, pod, file_name, regexp_replace(file_name, '\\.gz$', '') AS sort_key FROM log_files
ORDER BY sort_key, file_name""")
def q_rolled_sort(spark, sf_dir):
    return mf.rolled_sort(_files(spark, sf_dir)).select(
        "app", "pod", "file_name", fc.strip_gz("file_name").alias("sort_key"))


@register("tail_bytes", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST, """
requests AS (SELECT app || ':' || pod AS request_id, app, pod, 'stderr' AS log_type,
                    CAST(NULL AS BIGINT) AS req_offset, 512 AS byte_length FROM logs)""",
                                             osql.windows_cte()) + """
SELECT request_id, app, pod, start_byte, end_byte, total_bytes, status, slice_hex FROM winr""")
def q_tail_bytes(spark, sf_dir):
    from rollscope.operators.paging import tail_requests
    logs = _files(spark, sf_dir).select("app", "pod").distinct()
    return _slices(spark, sf_dir, requests=tail_requests(logs, 512)).select(*SLICE_COLS)


# ---------------------------------------------------------------- composites

@register("log_slices", osql.LOG_BASE + f"""
SELECT request_id, app, pod, start_byte, end_byte, total_bytes, status, slice_hex,
       {osql.HEADER} AS header FROM winr""")
def q_log_slices(spark, sf_dir):
    return _slices(spark, sf_dir).select(*SLICE_COLS, "header")


# ===================================================== applications & tenants

from rollscope.operators import executors as ex  # noqa: E402
from rollscope.operators import listing as ls  # noqa: E402
from rollscope.operators import paging as pg  # noqa: E402
from rollscope.operators import tenant as tn  # noqa: E402

APP_SQL = osql.with_ctes(osql.APPS, osql.POLICY)
ACCESS_SQL = osql.with_ctes(osql.APPS, osql.POLICY, osql.ACCESS_REQUESTS)
PAIRS_SQL = osql.with_ctes(osql.APPS, osql.POLICY, osql.ACCESS_PAIRS)

# --- Fixed query parameters of the registered listing queries ---
QUERY_TENANT = "1"
QUERY_STATUSES = ["completed"]
QUERY_MIN_DATE, QUERY_MAX_DATE = "1996-01-01", "2000-12-31"
QUERY_MIN_END, QUERY_MAX_END = "1996-01-01", "2001-06-30"
QUERY_NOW = "2001-01-01"
QUERY_LIMIT = 50
LISTING_LIMIT = 100
TENANT_CAP = 3
PROXY_BASE = "/proxy"
# ------------------------------------------------------------------


def _apps(spark, sf_dir):
    return fx.applications(spark, sf_dir)


def _flat(df):
    return ls.flatten_attempts(df)


FLAT_COLS = "id, name, attempt_idx, attemptId, startTime, endTime, completed"


def _time_sql(alias="s"):
    return (f"EXISTS (SELECT 1 FROM app_flat f WHERE f.id = {alias}.id AND f.attempt_idx IS NOT NULL"
            f" AND f.startTime >= TIMESTAMP '{QUERY_MIN_DATE}' AND f.startTime <= TIMESTAMP '{QUERY_MAX_DATE}'"
            f" AND (({alias}.any_running AND TIMESTAMP '{QUERY_MAX_END}' > TIMESTAMP '{QUERY_NOW}')"
            f" OR (NOT {alias}.any_running AND f.endTime >= TIMESTAMP '{QUERY_MIN_END}'"
            f" AND f.endTime <= TIMESTAMP '{QUERY_MAX_END}')))")


@register("applications_scan", APP_SQL + f"SELECT {FLAT_COLS} FROM app_flat")
def q_applications_scan(spark, sf_dir):
    from rollscope.sources.apps import read_applications, write_applications
    from rollscope.session import data_key, shared_dir
    path = f"{shared_dir(spark)}/fixture_apps/{data_key(sf_dir)}"
    write_applications(_apps(spark, sf_dir), path)
    return _flat(read_applications(spark, path))


@register("latest_attempt", APP_SQL + "SELECT id, head_attempt AS latest_attempt FROM app_summary")
def q_latest_attempt(spark, sf_dir):
    return _apps(spark, sf_dir).select("id", fc.latest_attempt("attempts").alias("latest_attempt"))


@register("any_running", APP_SQL + "SELECT id, any_running FROM app_summary")
def q_any_running(spark, sf_dir):
    flat = fx.application_attempts(spark, sf_dir)
    return flat.groupBy("id").agg(
        F.coalesce(F.bool_or(~F.col("completed")), F.lit(False)).alias("any_running"))


@register("app_status_filter", APP_SQL + "SELECT id, name FROM app_summary WHERE any_running")
def q_app_status_filter(spark, sf_dir):
    return ls.filter_status(_apps(spark, sf_dir), ["running"]).select("id", "name")


@register("attempt_time_range", APP_SQL + f"SELECT id, name FROM app_summary s WHERE {_time_sql()}")
def q_attempt_time_range(spark, sf_dir):
    return ls.filter_time_range(_apps(spark, sf_dir), QUERY_MIN_DATE, QUERY_MAX_DATE, QUERY_MIN_END,
                                QUERY_MAX_END, QUERY_NOW).select("id", "name")


@register("completed_view", APP_SQL + "SELECT id, name FROM app_summary WHERE head_completed")
def q_completed_view(spark, sf_dir):
    return ls.completed_view(_apps(spark, sf_dir), show_incomplete=False).select("id", "name")


@register("app_lookup", APP_SQL + """, ids AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id FROM part
  UNION ALL SELECT 'gone-' || CAST(s_suppkey AS VARCHAR) FROM supplier)
SELECT i.id, s.name FROM ids i LEFT JOIN app_summary s ON s.id = i.id""")
def q_app_lookup(spark, sf_dir):
    return ls.app_lookup(_apps(spark, sf_dir), fx.lookup_ids(spark, sf_dir)).select("id", "name")


@register("listing_order", APP_SQL + "SELECT id, name, head_end AS end_time FROM app_summary "
                                     "ORDER BY head_end DESC NULLS LAST, id")
def q_listing_order(spark, sf_dir):
    return ls.order_listing(_apps(spark, sf_dir)).select(
        "id", "name", ls.head_attempt("endTime").alias("end_time"))


@register("listing_limit", APP_SQL + f"SELECT id, name, head_end AS end_time FROM app_summary "
                                     f"ORDER BY head_end DESC NULLS LAST, id LIMIT {LISTING_LIMIT}")
def q_listing_limit(spark, sf_dir):
    return ls.limit_listing(_apps(spark, sf_dir), LISTING_LIMIT).select(
        "id", "name", ls.head_attempt("endTime").alias("end_time"))


@register("tenant_match", ACCESS_SQL + f"""
, j AS (SELECT r.*, s.name FROM access_req r LEFT JOIN app_summary s ON s.id = r.app_id)
SELECT request_id, tenant_id, app_id,
       coalesce(name IS NOT NULL AND {osql.visible_expr('name', 'tenant_id')}, false) AS visible,
       CASE WHEN name IS NULL THEN NULL
            WHEN name IN (SELECT name FROM exclusions_t) THEN 'exclusion'
            WHEN {osql.visible_expr('name', 'tenant_id')} THEN 'pattern' END AS reason
FROM j""")
def q_tenant_match(spark, sf_dir):
    return tn.tenant_match(fx.access_requests(spark, sf_dir), _apps(spark, sf_dir),
                           fx.policy(spark, sf_dir)).select(
        "request_id", "tenant_id", "app_id", "visible", "reason")


@register("tenant_listing", APP_SQL + f"""
SELECT id, name FROM app_summary WHERE {osql.visible_expr('name', "'" + QUERY_TENANT + "'")}""")
def q_tenant_listing(spark, sf_dir):
    return tn.tenant_listing(_apps(spark, sf_dir), QUERY_TENANT, fx.policy(spark, sf_dir)).select("id", "name")


@register("tenant_access", ACCESS_SQL + """
, j AS (SELECT r.*, s.name, s.head_attempt FROM access_req r LEFT JOIN app_summary s ON s.id = r.app_id)
SELECT request_id, tenant_id, app_id, CAST(NULL AS VARCHAR) AS attempt_id, head_attempt AS resolved_attempt,
       CASE WHEN name IS NULL THEN 'not_found'
            WHEN NOT (SELECT ne FROM excl_nonempty) THEN 'ok'
            WHEN name IN (SELECT name FROM exclusions_t) THEN 'ok'
            WHEN EXISTS (SELECT 1 FROM patterns_t p
                         WHERE starts_with(j.name, p.pattern || coalesce(j.tenant_id, 'null'))) THEN 'ok'
            ELSE 'forbidden' END AS decision
FROM j""")
def q_tenant_access(spark, sf_dir):
    return tn.tenant_access(fx.access_requests(spark, sf_dir), _apps(spark, sf_dir), fx.policy(spark, sf_dir))


@register("exclusion_split", APP_SQL + """
SELECT id, name, CASE WHEN name IN (SELECT name FROM exclusions_t) THEN 'exempt' ELSE 'subject' END AS side
FROM app_summary""")
def q_exclusion_split(spark, sf_dir):
    exempt, subject = tn.exclusion_split(_apps(spark, sf_dir), fx.policy(spark, sf_dir))
    return (exempt.select("id", "name", F.lit("exempt").alias("side"))
            .unionByName(subject.select("id", "name", F.lit("subject").alias("side"))))


@register("tenant_access_matrix", PAIRS_SQL + "SELECT app_id, name, tenant_id, shared_prefix FROM access_pairs")
def q_tenant_access_matrix(spark, sf_dir):
    return tn.access_matrix(_apps(spark, sf_dir), fx.tenants(spark, sf_dir), fx.policy(spark, sf_dir))


@register("access_audit", PAIRS_SQL + """
SELECT id AS app_id, name, CAST(NULL AS VARCHAR) AS tenant_id, 'exclusion' AS reason,
       CAST(NULL AS BOOLEAN) AS shared_prefix
FROM app_summary WHERE name IN (SELECT name FROM exclusions_t)
UNION ALL
SELECT app_id, name, tenant_id, 'pattern' AS reason, shared_prefix FROM access_pairs""")
def q_access_audit(spark, sf_dir):
    return tn.access_audit(_apps(spark, sf_dir), fx.tenants(spark, sf_dir), fx.policy(spark, sf_dir))


@register("has_visible_apps", PAIRS_SQL + """
, ex_any AS (SELECT bool_or(head_completed) AS c, bool_or(NOT head_completed) AS i
             FROM app_summary WHERE name IN (SELECT name FROM exclusions_t)),
own AS (SELECT p.tenant_id, bool_or(s.head_completed) AS c, bool_or(NOT s.head_completed) AS i
        FROM access_pairs p JOIN app_summary s ON s.id = p.app_id GROUP BY p.tenant_id)
SELECT t.tenant_id,
       coalesce((SELECT c FROM ex_any), false) OR coalesce(o.c, false) AS has_completed,
       coalesce((SELECT i FROM ex_any), false) OR coalesce(o.i, false) AS has_incomplete
FROM (SELECT DISTINCT tenant_id FROM tenants_t) t LEFT JOIN own o ON o.tenant_id = t.tenant_id""")
def q_has_visible_apps(spark, sf_dir):
    return ls.visible_views(_apps(spark, sf_dir), fx.tenants(spark, sf_dir), fx.policy(spark, sf_dir))


@register("max_apps", PAIRS_SQL + f"""
, ranked AS (
  SELECT p.tenant_id, p.app_id, s.name, s.head_end,
         row_number() OVER (PARTITION BY p.tenant_id ORDER BY s.head_end DESC NULLS LAST, p.app_id) AS rn
  FROM access_pairs p JOIN app_summary s ON s.id = p.app_id)
SELECT tenant_id, app_id AS id, name, head_end AS end_time FROM ranked WHERE rn <= {TENANT_CAP}""")
def q_max_apps(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    pairs = tn.access_matrix(apps, fx.tenants(spark, sf_dir), fx.policy(spark, sf_dir))
    j = pairs.select("tenant_id", F.col("app_id").alias("id")).join(apps, "id")
    return ls.cap(j, TENANT_CAP, partition_by="tenant_id").select(
        "tenant_id", "id", "name", ls.head_attempt("endTime").alias("end_time"))


@register("application_query", APP_SQL + f"""
, listed AS (SELECT * FROM app_summary s WHERE {osql.visible_expr('s.name', "'" + QUERY_TENANT + "'")}),
kept AS (SELECT * FROM listed s WHERE NOT any_running AND {_time_sql()}
         ORDER BY head_end DESC NULLS LAST, id LIMIT {QUERY_LIMIT})
SELECT f.id, f.name, f.attempt_idx, f.attemptId, f.startTime, f.endTime, f.completed
FROM kept k JOIN app_flat f ON f.id = k.id""")
def q_application_query(spark, sf_dir):
    out = ls.application_query(_apps(spark, sf_dir), QUERY_TENANT, fx.policy(spark, sf_dir), QUERY_STATUSES,
                               QUERY_MIN_DATE, QUERY_MAX_DATE, QUERY_MIN_END, QUERY_MAX_END,
                               QUERY_LIMIT, QUERY_NOW)
    return _flat(out)


@register("tenant_summary", APP_SQL + f"""
SELECT id, name, head_end AS end_time FROM app_summary s
WHERE {osql.visible_expr('s.name', "'" + QUERY_TENANT + "'")} AND NOT head_completed
ORDER BY head_end DESC NULLS LAST, id LIMIT {LISTING_LIMIT}""")
def q_tenant_summary(spark, sf_dir):
    out = ls.tenant_summary(_apps(spark, sf_dir), QUERY_TENANT, fx.policy(spark, sf_dir),
                            show_incomplete=True, max_apps=LISTING_LIMIT)
    return out.select("id", "name", ls.head_attempt("endTime").alias("end_time"))


# ================================================================ executors

EXEC_SQL = osql.with_ctes(osql.APPS, osql.EXECUTORS)
POD_SQL = "CASE WHEN e.id = 'driver' THEN e.id ELSE 'exec-' || coalesce(e.id, 'null') END"
URL_SQL = (f"'{PROXY_BASE}' || '/logPage/?appId=' || coalesce(s.name, 'null') || '&podId=' || "
           f"{POD_SQL} || '&logType=stderr'")
EXEC_FROM = "FROM executors_t e LEFT JOIN app_summary s ON s.id = e.app_id"


def _executors(spark, sf_dir):
    return fx.executors(spark, sf_dir)


@register("pod_id", EXEC_SQL + f"SELECT e.app_id, e.id, {POD_SQL} AS pod FROM executors_t e")
def q_pod_id(spark, sf_dir):
    return _executors(spark, sf_dir).select("app_id", "id", fc.pod_id("id").alias("pod"))


@register("executors_with_app", EXEC_SQL + f"SELECT e.app_id, e.id, s.name AS app_name {EXEC_FROM}")
def q_executors_with_app(spark, sf_dir):
    return ex.with_app(_executors(spark, sf_dir), _apps(spark, sf_dir)).select("app_id", "id", "app_name")


@register("executor_log_url", EXEC_SQL + f"SELECT e.app_id, e.id, {URL_SQL} AS log_url {EXEC_FROM}")
def q_executor_log_url(spark, sf_dir):
    j = ex.with_log_url(ex.with_app(_executors(spark, sf_dir), _apps(spark, sf_dir)), PROXY_BASE)
    return j.select("app_id", "id", "log_url")


@register("executor_log_map", EXEC_SQL + f"""
SELECT e.app_id, e.id, e.hostPort, e.isActive, e.totalTasks, e.addTime, e.removeTime,
       'logs' AS log_key, {URL_SQL} AS log_value {EXEC_FROM}""")
def q_executor_log_map(spark, sf_dir):
    j = ex.executor_links(_executors(spark, sf_dir), _apps(spark, sf_dir), PROXY_BASE)
    return j.select("app_id", "id", "hostPort", "isActive", "totalTasks", "addTime", "removeTime",
                    F.explode("executorLogs").alias("log_key", "log_value"))


@register("executor_lookup", EXEC_SQL + f"""
SELECT e.app_id, e.id, 'logs' AS log_key, {URL_SQL} AS log_value {EXEC_FROM} WHERE e.isActive""")
def q_executor_lookup(spark, sf_dir):
    j = ex.executor_links(_executors(spark, sf_dir), _apps(spark, sf_dir), PROXY_BASE, active_only=True)
    return j.select("app_id", "id", F.explode("executorLogs").alias("log_key", "log_value"))


@register("executor_by_id", EXEC_SQL + f"""
, asked AS (SELECT CAST(o_custkey AS VARCHAR) AS app_id, k.id FROM orders,
            (SELECT unnest(['driver', '1', 'none']) AS id) k)
SELECT a.app_id, a.id AS executor_id, e.id IS NOT NULL AS found,
       CASE WHEN e.id IS NOT NULL THEN {URL_SQL} END AS log_value
FROM asked a LEFT JOIN executors_t e ON e.app_id = a.app_id AND e.id = a.id LEFT JOIN app_summary s ON s.id = e.app_id""")
def q_executor_by_id(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("app_id"),
        F.explode(F.array(F.lit("driver"), F.lit("1"), F.lit("none"))).alias("executor_id"))
    found = ex.executor_by_id(asked, _executors(spark, sf_dir), _apps(spark, sf_dir), PROXY_BASE)
    return found.select("app_id", "executor_id", F.col("id").isNotNull().alias("found"),
                        F.element_at("executorLogs", "logs").alias("log_value"))


@register("executor_links", EXEC_SQL + f"""
SELECT e.app_id, s.name AS app_name, e.id, {POD_SQL} AS pod, e.isActive, 'logs' AS log_key,
       {URL_SQL} AS log_value {EXEC_FROM}""")
def q_executor_links(spark, sf_dir):
    j = ex.executor_links(_executors(spark, sf_dir), _apps(spark, sf_dir), PROXY_BASE)
    return j.select("app_id", "app_name", "id", "pod", "isActive",
                    F.explode("executorLogs").alias("log_key", "log_value"))


# =================================================================== paging

CURSORS_SQL = """
totals AS (SELECT app, pod, CAST(sum(length) AS BIGINT) AS total_bytes,
                  CAST(max_by(length, seq) AS BIGINT) AS last_file_bytes FROM log_files GROUP BY app, pod),
cursors AS (
  SELECT 'client-1' AS client, app, pod, greatest(total_bytes - last_file_bytes - 512, 0) AS start_byte,
         total_bytes - last_file_bytes AS end_byte, total_bytes - last_file_bytes AS total_bytes_seen,
         512 AS byte_length FROM totals)"""


@register("load_more", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST, CURSORS_SQL, """
requests AS (SELECT client || ':' || app || ':' || pod AS request_id, app, pod, 'stderr' AS log_type,
                    greatest(start_byte - byte_length, 0) AS req_offset,
                    CAST(least(byte_length, start_byte) AS INTEGER) AS byte_length FROM cursors)""",
                                       osql.windows_cte()) + """
SELECT request_id, app, pod, start_byte, end_byte, total_bytes, status, slice_hex FROM winr""")
def q_load_more(spark, sf_dir):
    return _slices(spark, sf_dir, requests=pg.prev_window(fx.log_cursors(spark, sf_dir))).select(*SLICE_COLS)


@register("load_new", osql.with_ctes(osql.LOG_FILES, osql.LOGS, osql.MANIFEST, CURSORS_SQL, """
requests AS (SELECT c.client || ':' || c.app || ':' || c.pod AS request_id, c.app, c.pod, 'stderr' AS log_type,
                    c.total_bytes_seen AS req_offset,
                    CAST(greatest(t.total_bytes - c.total_bytes_seen, 0) AS INTEGER) AS byte_length,
                    CASE WHEN t.total_bytes > c.total_bytes_seen THEN 'new_bytes'
                         WHEN t.total_bytes = c.total_bytes_seen THEN 'no_new' ELSE 'truncated' END AS poll_status
             FROM cursors c JOIN totals t ON t.app = c.app AND t.pod = c.pod)""",
                                      osql.windows_cte()) + """
SELECT request_id, app, pod, poll_status, start_byte, end_byte, total_bytes, slice_hex FROM winr""")
def q_load_new(spark, sf_dir):
    reqs = pg.new_bytes(fx.log_cursors(spark, sf_dir), fx.log_totals(spark, sf_dir))
    return _slices(spark, sf_dir, requests=reqs, carry=["poll_status"]).select(
        "request_id", "app", "pod", "poll_status", "start_byte", "end_byte", "total_bytes", "slice_hex")


@register("poll_requests", osql.with_ctes(osql.LOG_FILES, CURSORS_SQL) + """
SELECT c.client || ':' || c.app || ':' || c.pod AS request_id, 'new_bytes' AS poll_status, total_bytes_seen AS req_offset,
       t.total_bytes - total_bytes_seen AS byte_length
FROM cursors c JOIN totals t ON t.app = c.app AND t.pod = c.pod WHERE t.total_bytes > total_bytes_seen
UNION ALL
SELECT client || ':' || app || ':' || pod, 'more', greatest(start_byte - byte_length, 0), least(byte_length, start_byte)
FROM cursors WHERE start_byte > 0""")
def q_poll_requests(spark, sf_dir):
    """G1 and G2 as a stream: clients open every log and page back, its newest file arrives after a restart."""
    import uuid

    from rollscope.session import shared_dir
    from rollscope.streaming import cursors as cu
    base = f"{shared_dir(spark)}/fixture_polls/{uuid.uuid4().hex}"
    seen, shown = fx.log_totals(spark, sf_dir), fx.log_cursors(spark, sf_dir)
    zero = F.lit(0).cast("long")
    for kind, seq in ((cu.OPEN, 1), (cu.MORE, 2)):
        shown.select(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), "client", "app", "pod", "start_byte", "end_byte",
                     "total_bytes", F.col("byte_length").cast("long").alias("byte_length")).write.mode("append").parquet(base + "/clients")
    first = seen.withColumn("total_bytes", F.col("total_bytes") - F.col("last_file_bytes"))
    for seq, totals in ((1, first), (2, seen)):
        totals.select("app", "pod", F.col("total_bytes") + zero, F.lit(seq).cast("long").alias("seq")).toDF(
            "app", "pod", "total_bytes", "seq").write.mode("append").parquet(base + "/totals")
        requests = cu.poll_requests(spark.readStream.schema(cu.TOTALS).parquet(base + "/totals"),
                                    spark.readStream.schema(cu.CLIENT_EVENTS).parquet(base + "/clients"))
        (requests.writeStream.format("parquet").option("path", base + "/requests").option("checkpointLocation", base + "/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(cu.REQUESTS).parquet(base + "/requests").select(
        "request_id", "poll_status", F.col("offset").alias("req_offset"), "byte_length")


PAGE_BYTES = 1024


@register("page_plan", osql.with_ctes(osql.LOG_FILES, """
totals AS (SELECT app, pod, CAST(sum(length) AS BIGINT) AS total_bytes FROM log_files GROUP BY app, pod)""") + f"""
SELECT app, pod, p AS page_no, greatest(total_bytes - (p + 1) * {PAGE_BYTES}, 0) AS start_byte,
       total_bytes - p * {PAGE_BYTES} AS end_byte, total_bytes
FROM totals, LATERAL (SELECT unnest(range(0, CAST(ceil(total_bytes / {PAGE_BYTES}) AS BIGINT))) AS p)
WHERE total_bytes > 0""")
def q_page_plan(spark, sf_dir):
    return pg.page_plan(fx.log_totals(spark, sf_dir), PAGE_BYTES)


# ========================================================== real rolled files

from rollscope.sources import files as fl  # noqa: E402
from rollscope.sources.materialize import materialize_logs  # noqa: E402

FILE_NAMES_SQL = osql.with_ctes(osql.LOG_FILES)


def _home(spark, sf_dir):
    return materialize_logs(spark, sf_dir)


def _file_chunks(spark, sf_dir):
    return fl.build_chunks(spark, _home(spark, sf_dir), fx.CHUNK_BYTES)


@register("log_file_scan", FILE_NAMES_SQL + "SELECT app, file_name, file_name LIKE '%.gz' AS compressed FROM log_files")
def q_log_file_scan(spark, sf_dir):
    return fl.scan_log_files(spark, _home(spark, sf_dir)).select(
        "app", "file_name", F.col("file_name").endswith(".gz").alias("compressed"))


@register("log_chunks", FILE_NAMES_SQL + f"""
SELECT app, file_name, k AS chunk_no,
       CAST(least(length - k * {fx.CHUNK_BYTES}, {fx.CHUNK_BYTES}) AS BIGINT) AS n_bytes,
       substr(hex(content), CAST(2 * k * {fx.CHUNK_BYTES} + 1 AS BIGINT), {2 * fx.CHUNK_BYTES}) AS chunk_hex
FROM log_files, LATERAL (SELECT unnest(range(0, CAST(ceil(length / {fx.CHUNK_BYTES}) AS BIGINT))) AS k)
WHERE length > 0""")
def q_log_chunks(spark, sf_dir):
    c = _file_chunks(spark, sf_dir)
    return c.where("chunk_no >= 0").select("app", F.element_at(F.split("path", "/"), -1).alias("file_name"), "chunk_no",
                    F.octet_length("bytes").cast("long").alias("n_bytes"), F.hex("bytes").alias("chunk_hex"))


@register("uncompressed_length", FILE_NAMES_SQL + "SELECT app, file_name, length FROM log_files")
def q_uncompressed_length(spark, sf_dir):
    home = _home(spark, sf_dir)
    files = fl.scan_log_files(spark, home)
    return fl.uncompressed_length(files, fl.build_chunks(spark, home, fx.CHUNK_BYTES)).select(
        "app", "file_name", "length")


@register("log_manifest_sink", FILE_NAMES_SQL + "SELECT app, file_name, length FROM log_files")
def q_log_manifest_sink(spark, sf_dir):
    from rollscope.session import data_key, shared_dir
    home = _home(spark, sf_dir)
    base = f"{shared_dir(spark)}/fixture_tables/{data_key(sf_dir)}"
    table = fl.refresh_file_table(spark, home, base + "/files", base + "/chunks", fx.CHUNK_BYTES)
    return table.select("app", "file_name", "length")


SLICES_OF_FILES_SQL = osql.LOG_BASE + f"""
SELECT request_id, app, pod, start_byte, end_byte, total_bytes, status, slice_hex,
       printf('==== Bytes %d-%d of %d of %s%s ====', start_byte, end_byte, total_bytes,
              '<home>/' || app || '/', log_type) || chr(10) AS header FROM winr"""


@register("log_slices_files", SLICES_OF_FILES_SQL)
def q_log_slices_files(spark, sf_dir):
    """Q1 on the real files: listing, gunzip-chunking, lengths, then the slice plan."""
    from rollscope.session import data_key, shared_dir
    home = _home(spark, sf_dir)
    base = f"{shared_dir(spark)}/fixture_tables/{data_key(sf_dir)}"
    snap = fl.list_home(spark, home)
    files = fl.refresh_file_table(spark, home, base + "/files", base + "/chunks", fx.CHUNK_BYTES, snapshot=snap)
    out = sl.log_slices(_requests(spark, sf_dir), files, fl.read_locators(spark, base + "/chunks"), home="<home>",
                        dirs=fl.log_directories(spark, home, snap), chunk_bytes=fx.CHUNK_BYTES,
                        bucket_bytes=fx.BUCKET_BYTES, with_text=False)
    return out.select(*SLICE_COLS, "header")


@register("log_slices_direct", SLICES_OF_FILES_SQL)
def q_log_slices_direct(spark, sf_dir):
    """Q1 without a chunk table: ranges of plain files by position, of gzip files from their restart points."""
    from rollscope.session import data_key, shared_dir
    from rollscope.sources import gzindex as gi
    home = _home(spark, sf_dir)
    snap = fl.list_home(spark, home)
    restarts = gi.refresh_restarts(spark, home, f"{shared_dir(spark)}/fixture_tables/{data_key(sf_dir)}/restarts",
                                   fx.CHUNK_BYTES, snapshot=snap)
    out = sl.log_slices(_requests(spark, sf_dir), fl.file_table(spark, home, snap, restarts), None, home="<home>",
                        dirs=fl.log_directories(spark, home, snap), bucket_bytes=fx.BUCKET_BYTES, with_text=False,
                        restarts=restarts)
    return out.select(*SLICE_COLS, "header")


# ================================================================ event logs

from rollscope.sources import eventlog as evl  # noqa: E402
from rollscope.streaming.rolled import ingested_files, stream_rolled_files  # noqa: E402


def _event_lines(spark, sf_dir):
    """Event lines staged once per shared folder as a (log, value) table."""
    from rollscope.session import data_key, shared_dir
    root = f"{shared_dir(spark)}/fixture_eventlogs/{data_key(sf_dir)}"
    if not _exists(spark, root + "/_SUCCESS"):
        evl.write_event_logs(evl.event_lines_of(fx.application_attempts(spark, sf_dir),
                                                fx.executors(spark, sf_dir)), root)
    return spark.read.parquet(root)


def _exists(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@register("event_log_tables", APP_SQL + """
SELECT id, name, attempt_idx, attemptId, startTime, CASE WHEN completed THEN endTime END AS endTime, completed
FROM app_flat WHERE attempt_idx IS NOT NULL""")
def q_event_log_tables(spark, sf_dir):
    apps, _ = evl.event_logs_to_tables(_event_lines(spark, sf_dir))
    return _flat(apps).where(F.col("attempt_idx").isNotNull())


@register("event_log_executors", osql.with_ctes(osql.APPS, osql.EXECUTORS, osql.EXECUTOR_URLS) + """
SELECT x.app_id, f.attemptId, x.id, x.hostPort AS host, x.totalTasks AS totalCores,
       date_trunc('millisecond', x.addTime) AS addTime, true AS isActive, x.log_name, x.log_url
FROM executor_urls x JOIN app_flat f ON f.id = x.app_id AND f.attempt_idx = 0""")
def q_event_log_executors(spark, sf_dir):
    _, ex_ = evl.event_logs_to_tables(_event_lines(spark, sf_dir))
    return ex_.select("app_id", "attemptId", "id", "host", "totalCores", "addTime", "isActive",
                      F.explode("executorLogs").alias("log_name", "log_url"))


@register("event_log_export", osql.with_ctes(osql.APPS, osql.EXECUTORS, osql.EVENT_LINES) + """
SELECT app_id, attempt_id, row_number() OVER (PARTITION BY app_id, attempt_id ORDER BY line) - 1 AS position,
       md5(value) AS line_md5
FROM event_lines WHERE app_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')""")
def q_event_log_export(spark, sf_dir):
    """Every exported line, at its place in the attempt's part files."""
    from rollscope.session import data_key, shared_dir
    lines = _event_lines(spark, sf_dir)
    wanted = (fx.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
              .select(F.col("user_id").cast("string").alias("app_id")).distinct()
              .withColumn("attempt_id", F.lit(None).cast("string")))
    out = f"{shared_dir(spark)}/fixture_export/{data_key(sf_dir)}"
    evl.export_event_logs(lines, wanted, out)
    back = evl.read_exported(spark, out)
    place = Window.partitionBy("app_id", "attempt_id").orderBy("part", "at")
    return back.select("app_id", "attempt_id", (F.row_number().over(place) - 1).cast("long").alias("position"), F.md5("value").alias("line_md5"))


@register("stream_rolled_files", FILE_NAMES_SQL + "SELECT app, file_name, length FROM log_files")
def q_stream_rolled_files(spark, sf_dir):
    from rollscope.session import data_key, shared_dir
    home = _home(spark, sf_dir)
    base = f"{shared_dir(spark)}/fixture_stream/{data_key(sf_dir)}"
    stream_rolled_files(spark, home, base + "/out", base + "/checkpoint", fx.CHUNK_BYTES)
    return ingested_files(spark, base + "/out").select("app", "file_name", "length")
