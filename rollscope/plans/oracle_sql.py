"""The fixture views of ``rollscope.sources.fixtures`` and the oracle queries, in SQL.

These run in DuckDB over the driver tables; each oracle must produce the
same columns and values as the matching Spark query in ``registry``.
"""

from __future__ import annotations

NL = "chr(10)"

LOG_FILES = """
conv_rows AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS app, 'driver' AS pod, CAST(turn AS BIGINT) AS seq,
         encode(text) AS content FROM conversations),
doc_rows AS (
  SELECT source AS app, lang AS pod, CAST(doc_id AS BIGINT) AS seq, encode(text) AS content
  FROM documents),
log_rows AS (SELECT * FROM conv_rows UNION ALL SELECT * FROM doc_rows),
log_files AS (
  SELECT app, pod, seq,
         app || '-' || pod || '_' || lpad(CAST(seq AS VARCHAR), 10, '0')
           || CASE WHEN octet_length(content) > 1024 THEN '.gz' ELSE '' END AS file_name,
         CAST(octet_length(content) AS BIGINT) AS length, content
  FROM log_rows),
log_files_p AS (
  SELECT *, 'logs/' || app || '/' || file_name AS path FROM log_files)"""

LOGS = """
logs AS (SELECT DISTINCT app, pod FROM log_files)"""

REQUESTS = """
shapes(k, off, n) AS (VALUES (1, NULL, 512), (2, 0, 100), (3, -5, 64), (4, 1000000000, 64),
                             (5, 50, 0), (6, NULL, -1), (7, 300, 102400)),
requests AS (
  SELECT app || ':' || pod || ':' || CAST(k AS VARCHAR) AS request_id, app, pod,
         'stderr' AS log_type, CAST(off AS BIGINT) AS req_offset, CAST(n AS INTEGER) AS byte_length
  FROM logs, shapes)"""

# files matched to each requested log, ranked and placed on the byte axis
MANIFEST = """
matched AS (
  SELECT l.app, l.pod, f.file_name, f.path, f.length, f.content
  FROM logs l JOIN log_files_p f
    ON f.app = l.app AND starts_with(f.file_name, l.app) AND contains(f.file_name, '-' || l.pod || '_')),
manifest AS (
  SELECT app, pod, file_name, path, length, content,
         row_number() OVER (PARTITION BY app, pod
                            ORDER BY regexp_replace(file_name, '\\.gz$', ''), file_name) AS file_rank,
         CAST(coalesce(sum(length) OVER (PARTITION BY app, pod
                            ORDER BY regexp_replace(file_name, '\\.gz$', ''), file_name
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_start
  FROM matched),
manifest_x AS (SELECT *, file_start + length AS file_end FROM manifest),
log_hex AS (
  SELECT app, pod, string_agg(hex(content), '' ORDER BY file_rank) AS hx,
         CAST(sum(length) AS BIGINT) AS total_bytes
  FROM manifest_x GROUP BY app, pod),
dirs AS (SELECT DISTINCT app AS dir_app FROM log_files)"""


def windows_cte(requests: str = "requests") -> str:
    """Resolved windows + status for a request relation with req_offset / byte_length."""
    return f"""
w0 AS (
  SELECT r.*, CAST(coalesce(h.total_bytes, 0) AS BIGINT) AS tot, h.hx,
         d.dir_app IS NOT NULL AS has_dir
  FROM {requests} r LEFT JOIN log_hex h ON h.app = r.app AND h.pod = r.pod
  LEFT JOIN dirs d ON d.dir_app = r.app),
w1 AS (SELECT *, coalesce(req_offset, tot - byte_length) AS off FROM w0),
w2 AS (SELECT *, CASE WHEN off < 0 THEN 0 WHEN off > tot THEN tot ELSE off END AS s FROM w1),
w3 AS (SELECT *, least(s + byte_length, tot) AS e FROM w2),
win AS (
  SELECT *,
    CASE WHEN app IS NULL OR pod IS NULL THEN 'bad_request'
         WHEN NOT has_dir THEN 'missing_dir'
         WHEN e < s THEN 'negative_length' ELSE 'ok' END AS status
  FROM w3),
winr AS (
  SELECT *,
    CAST(CASE WHEN status = 'ok' THEN s ELSE 0 END AS BIGINT) AS start_byte,
    CAST(CASE WHEN status = 'ok' THEN e ELSE 0 END AS BIGINT) AS end_byte,
    CAST(CASE WHEN status = 'ok' THEN tot ELSE 0 END AS BIGINT) AS total_bytes,
    CASE WHEN status = 'ok' THEN coalesce(substr(hx, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)), '')
    END AS slice_hex
  FROM win)"""


HEADER = ("printf('==== Bytes %d-%d of %d of %s%s ====', start_byte, end_byte, total_bytes, "
          "'logs/' || app || '/', log_type) || " + NL)


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


LOG_BASE = with_ctes(LOG_FILES, LOGS, REQUESTS, MANIFEST, windows_cte())

APPS = """
app_base AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         c_mktsegment || '-' || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS name,
         o_orderkey, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey),
att AS (
  SELECT l_orderkey, l_shipdate, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey,
                            l_suppkey, l_extendedprice) - 1 AS idx,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
app_flat AS (
  SELECT a.id, a.name, CAST(t.idx AS INTEGER) AS attempt_idx, CAST(t.n - t.idx AS VARCHAR) AS attemptId,
         CASE WHEN t.idx IS NOT NULL THEN a.o_orderdate END AS startTime, t.l_shipdate AS endTime,
         t.l_linestatus = 'F' AS completed
  FROM app_base a LEFT JOIN att t ON t.l_orderkey = a.o_orderkey),
app_summary AS (
  SELECT id, name,
         coalesce(bool_or(NOT completed), false) AS any_running,
         max(CASE WHEN attempt_idx = 0 THEN endTime END) AS head_end,
         coalesce(bool_or(attempt_idx = 0 AND completed), false) AS head_completed,
         max(CASE WHEN attempt_idx = 0 THEN attemptId END) AS head_attempt
  FROM app_flat GROUP BY id, name)"""

POLICY = """
tenants_t AS (SELECT CAST(c_custkey AS VARCHAR) AS tenant_id FROM customer),
patterns_t AS (SELECT DISTINCT c_mktsegment || '-' AS pattern FROM customer),
exclusions_t AS (
  SELECT c_mktsegment || '-' || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS name
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
excl_nonempty AS (SELECT count(*) > 0 AS ne FROM exclusions_t)"""

ACCESS_REQUESTS = """
access_req AS (
  SELECT 'own:' || CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS tenant_id,
         CAST(o_orderkey AS VARCHAR) AS app_id FROM orders
  UNION ALL
  SELECT 'other:' || CAST(o_orderkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR), CAST(o_orderkey AS VARCHAR)
  FROM orders
  UNION ALL
  SELECT 'missing:' || CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), 'gone-' || CAST(s_suppkey AS VARCHAR)
  FROM supplier)"""


def visible_expr(name: str, tenant: str) -> str:
    """Listing rule in SQL for a name and a tenant expression."""
    return (f"(({name}) IN (SELECT name FROM exclusions_t) OR ((SELECT ne FROM excl_nonempty) AND EXISTS "
            f"(SELECT 1 FROM patterns_t p WHERE starts_with({name}, p.pattern || coalesce({tenant}, 'null')))))")


ACCESS_PAIRS = """
hits AS (
  SELECT s.id AS app_id, s.name, p.pattern, substr(s.name, length(p.pattern) + 1) AS rest
  FROM app_summary s JOIN patterns_t p ON starts_with(s.name, p.pattern)
  WHERE s.name NOT IN (SELECT name FROM exclusions_t) AND (SELECT ne FROM excl_nonempty)),
pairs AS (
  SELECT h.*, t.tenant_id, length(coalesce(t.tenant_id, 'null')) AS tlen
  FROM hits h JOIN (SELECT DISTINCT tenant_id FROM tenants_t) t ON starts_with(h.rest, coalesce(t.tenant_id, 'null'))),
pairs_sp AS (SELECT *, tlen < max(tlen) OVER (PARTITION BY app_id, pattern) AS shared FROM pairs),
access_pairs AS (
  SELECT app_id, name, tenant_id, bool_or(shared) AS shared_prefix FROM pairs_sp GROUP BY app_id, name, tenant_id)"""

EXECUTORS = """
ev AS (
  SELECT user_id, event_type, count(*) AS n, min(ts) AS addTime, max(ts) AS lastTime, max(value) AS maxValue
  FROM events GROUP BY user_id, event_type),
executors_t AS (
  SELECT CAST(user_id AS VARCHAR) AS app_id,
         CASE event_type WHEN 'error' THEN 'driver' WHEN 'click' THEN '1' WHEN 'purchase' THEN '2'
                         WHEN 'signup' THEN '3' WHEN 'view' THEN '4' END AS id,
         'host-' || CAST(user_id AS VARCHAR) || ':7337' AS hostPort,
         maxValue >= 40.0 AS isActive, CAST(n AS INTEGER) AS totalTasks, addTime,
         CASE WHEN NOT (maxValue >= 40.0) THEN lastTime END AS removeTime
  FROM ev)"""

EXECUTOR_URLS = """
executor_urls AS (
  SELECT e.*, u.log_name, 'http://worker/logs/' || e.app_id || '/' ||
         CASE e.id WHEN 'driver' THEN 'error' WHEN '1' THEN 'click' WHEN '2' THEN 'purchase'
                   WHEN '3' THEN 'signup' WHEN '4' THEN 'view' END || '/' || u.log_name AS log_url
  FROM executors_t e, (SELECT unnest(['stdout', 'stderr']) AS log_name) u)"""

# the JSON lines of each attempt's event log, in order
EVENT_LINES = """
event_types(id, t) AS (VALUES ('driver', 'error'), ('1', 'click'), ('2', 'purchase'), ('3', 'signup'), ('4', 'view')),
event_lines AS (
  SELECT id AS app_id, attemptId AS attempt_id, 0 AS line,
         '{"Event":"SparkListenerApplicationStart","App Name":"' || name || '","App ID":"' || id || '","Timestamp":'
         || CAST(epoch_us(CAST(startTime AS TIMESTAMP)) // 1000 AS VARCHAR) || ',"User":"rollscope","App Attempt ID":"' || attemptId || '"}' AS value
  FROM app_flat WHERE attempt_idx IS NOT NULL
  UNION ALL
  SELECT f.id, f.attemptId, row_number() OVER (PARTITION BY f.id ORDER BY e.id),
         '{"Event":"SparkListenerExecutorAdded","Timestamp":' || CAST(epoch_us(CAST(e.addTime AS TIMESTAMP)) // 1000 AS VARCHAR)
         || ',"Executor ID":"' || e.id || '","Executor Info":{"Host":"' || e.hostPort || '","Total Cores":' || CAST(e.totalTasks AS VARCHAR)
         || ',"Log Urls":{"stdout":"http://worker/logs/' || e.app_id || '/' || t.t || '/stdout","stderr":"http://worker/logs/'
         || e.app_id || '/' || t.t || '/stderr"}}}'
  FROM executors_t e JOIN event_types t ON t.id = e.id JOIN app_flat f ON f.id = e.app_id AND f.attempt_idx = 0
  UNION ALL
  SELECT id, attemptId, 1000000000,
         '{"Event":"SparkListenerApplicationEnd","Timestamp":' || CAST(epoch_us(CAST(endTime AS TIMESTAMP)) // 1000 AS VARCHAR) || '}'
  FROM app_flat WHERE attempt_idx IS NOT NULL AND completed)"""
