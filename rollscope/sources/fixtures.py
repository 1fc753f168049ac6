"""Views of the driver's tables in the shapes the operators consume.

Each builder reads the parquet tables of one scale-factor folder and derives a
log / application / tenant table from them with DataFrame operations, so the
work grows with the tables.  ``rollscope.plans.oracle_sql`` states the same
views in SQL for the DuckDB oracle; the two must stay in step.

Mapping (see FIXTURES.md):
* conversation logs: app ``conv-<conv_id>``, pod ``driver``, one file per turn
* document logs: app = ``source``, pod = ``lang``, one file per document
* file name ``<app>-<pod>_<10-digit seq>``; files over 1 KiB carry ``.gz`` and are
  stored gzip-compressed, smaller ones plain
* applications: one per order, attempts from its line items (newest first)
* executors: one per (user, event type) of ``events``
* tenants: customer keys; patterns: ``<segment>-``; exclusions: names of urgent
  partially-filled orders
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_HOME = "logs"
CHUNK_BYTES = 512      # small against the fixture files, so that they have many chunks and blocks
BUCKET_BYTES = 1 << 12

# --- Fixed values of the fixture requests: (offset, byte_length) per log ---
REQUEST_SHAPES = [
    (1, None, 512),
    (2, 0, 100),
    (3, -5, 64),
    (4, 1000000000, 64),
    (5, 50, 0),
    (6, None, -1),
    (7, 300, 102400),
]
# executor id per event type; "error" events stand for the driver
EXECUTOR_OF_EVENT = {"error": "driver", "click": "1", "purchase": "2", "signup": "3", "view": "4"}
# files larger than this are stored gzip-compressed (size-based rotation policy)
GZ_ABOVE_BYTES = 1024
# exclusion rule over orders
EXCLUDED_PRIORITY = "1-URGENT"
EXCLUDED_STATUS = "P"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_name(app: Column, pod: Column, seq: Column, length: Column) -> Column:
    base = F.concat(app, F.lit("-"), pod, F.lit("_"), F.lpad(seq.cast("string"), 10, "0"))
    return F.when(length > F.lit(GZ_ABOVE_BYTES), F.concat(base, F.lit(".gz"))).otherwise(base)


def _log_rows(df: DataFrame, app: Column, pod: Column, seq: Column, text: Column) -> DataFrame:
    # a per-row rule only (no window): branches that need metadata alone let
    # the optimizer drop the text right at the scan
    rows = df.select(app.alias("app"), pod.alias("pod"), seq.cast("long").alias("seq"),
                     F.encode(text, "UTF-8").alias("content"),
                     F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("length"))
    return (rows.withColumn("file_name", _file_name(F.col("app"), F.col("pod"), F.col("seq"), F.col("length")))
            .select("app", "pod", "seq", "file_name",
                    F.concat(F.lit(LOG_HOME + "/"), F.col("app"), F.lit("/"), F.col("file_name")).alias("path"),
                    "length", "content"))


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return _log_rows(conv, F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.lit("driver"),
                     F.col("turn"), F.col("text"))


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _log_rows(docs, F.col("source"), F.col("lang"), F.col("doc_id"), F.col("text"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File table with uncompressed ``content``: conversation and document logs."""
    return conversation_logs(spark, sf_dir).unionByName(document_logs(spark, sf_dir))


def log_chunks(spark: SparkSession, sf_dir: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    from rollscope.operators.slices import chunks_from_content
    return chunks_from_content(log_files(spark, sf_dir), chunk_bytes)


def chunk_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of the fixture logs' chunks; the chunk table is written once per shared folder."""
    from rollscope.session import data_key, shared_dir
    from rollscope.sources.files import locate_chunks, write_chunks
    from rollscope.sources.storage import hadoop_folder
    base = f"{shared_dir(spark)}/fixture_chunks/{data_key(sf_dir)}"
    fs, done = hadoop_folder(spark, base + "/at/_SUCCESS")
    if not fs.exists(done):
        write_chunks(log_chunks(spark, sf_dir), base + "/chunks", mode="overwrite")
        locate_chunks(spark.read.parquet(base + "/chunks")).write.mode("overwrite").parquet(base + "/at")
    return spark.read.parquet(base + "/at")


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven request shapes for every log (tail, head, negative, far, empty, bad, big)."""
    logs = log_files(spark, sf_dir).select("app", "pod").distinct()
    shapes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).cast("long").alias("offset"),
                                F.lit(n).cast("int").alias("byte_length"))
                       for k, o, n in REQUEST_SHAPES])
    r = logs.select("app", "pod", F.inline(shapes))
    return r.select(F.concat_ws(":", "app", "pod", F.col("k").cast("string")).alias("request_id"),
                    "app", "pod", F.lit("stderr").alias("log_type"), "offset", "byte_length")


def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (log_files(spark, sf_dir).groupBy("app", "pod")
            .agg(F.sum("length").cast("long").alias("total_bytes"),
                 F.max_by("length", "seq").cast("long").alias("last_file_bytes")))


def log_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client that last saw each log before its newest file arrived, 512-byte pages."""
    t = log_totals(spark, sf_dir)
    seen = (F.col("total_bytes") - F.col("last_file_bytes")).cast("long")
    return t.select(
        F.lit("client-1").alias("client"), "app", "pod",
        F.greatest(seen - F.lit(512), F.lit(0).cast("long")).alias("start_byte"),
        seen.alias("end_byte"), seen.alias("total_bytes"), F.lit(512).alias("byte_length"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested applications: ``id, name, attempts ARRAY<STRUCT<...>>`` newest first.

    One group per order: its line items sorted by ship date (newest first),
    ties by line number, part, supplier, price (all ascending -- negated inside
    a descending struct sort, so no comparator lambda runs per element).
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem")
    key = F.struct(F.col("l_shipdate").alias("d"), (-F.col("l_linenumber")).alias("ln"),
                   (-F.col("l_partkey")).alias("pk"), (-F.col("l_suppkey")).alias("sk"),
                   (-F.col("l_extendedprice")).alias("ep"), F.col("l_linestatus").alias("st"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(key), asc=False).alias("lines"))
    base = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", "o_orderdate",
        F.concat_ws("-", "c_mktsegment", F.col("o_custkey").cast("string"),
                    F.col("o_orderkey").cast("string")).alias("name"))
    j = base.join(lines, base["o_orderkey"] == lines["l_orderkey"], "left")
    arr = F.coalesce(F.col("lines"), F.array())
    attempts = F.transform(arr, lambda x, i: F.struct(
        (F.size(arr) - i).cast("string").alias("attemptId"),
        F.col("o_orderdate").alias("startTime"),
        x["d"].alias("endTime"),
        (x["st"] == "F").alias("completed")))
    return j.select(F.col("o_orderkey").cast("string").alias("id"), "name", attempts.alias("attempts"))


def application_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat applications: one row per attempt, NULL attempt for apps without any."""
    apps = applications(spark, sf_dir)
    return apps.select("id", "name", F.posexplode_outer("attempts").alias("attempt_idx", "a")).select(
        "id", "name", "attempt_idx", "a.attemptId", "a.startTime", "a.endTime", "a.completed")


def executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One executor per (user, event type) of ``events``; the user id is the app id."""
    ev = table(spark, sf_dir, "events")
    exec_id = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EXECUTOR_OF_EVENT.items()])
    g = ev.groupBy("user_id", "event_type").agg(
        F.count("*").cast("int").alias("totalTasks"),
        F.min("ts").alias("addTime"),
        F.max("ts").alias("lastTime"),
        F.max("value").alias("maxValue"))
    active = F.col("maxValue") >= F.lit(40.0)
    return g.select(
        F.col("user_id").cast("string").alias("app_id"),
        exec_id.alias("id"),
        F.concat(F.lit("host-"), F.col("user_id").cast("string"), F.lit(":7337")).alias("hostPort"),
        active.alias("isActive"),
        "totalTasks", "addTime",
        F.when(~active, F.col("lastTime")).alias("removeTime"),
        F.create_map(F.lit("stdout"), F.concat(F.lit("http://worker/logs/"), F.col("user_id").cast("string"),
                                               F.lit("/"), F.col("event_type"), F.lit("/stdout")),
                     F.lit("stderr"), F.concat(F.lit("http://worker/logs/"), F.col("user_id").cast("string"),
                                               F.lit("/"), F.col("event_type"), F.lit("/stderr"))
                     ).alias("executorLogs"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tenant_id"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer")
            .select(F.concat(F.col("c_mktsegment"), F.lit("-")).alias("pattern")).distinct())


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    o = orders.where((F.col("o_orderpriority") == EXCLUDED_PRIORITY) & (F.col("o_orderstatus") == EXCLUDED_STATUS))
    return o.join(customer, o["o_custkey"] == customer["c_custkey"]).select(
        F.concat_ws("-", "c_mktsegment", F.col("o_custkey").cast("string"),
                    F.col("o_orderkey").cast("string")).alias("name"))


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant, application) pairs to decide: each order asked for by its own
    customer and by the next customer key, and unknown applications asked for
    by suppliers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    own = orders.select(F.concat(F.lit("own:"), F.col("o_orderkey").cast("string")).alias("request_id"),
                        F.col("o_custkey").cast("string").alias("tenant_id"),
                        F.col("o_orderkey").cast("string").alias("app_id"))
    other = orders.select(F.concat(F.lit("other:"), F.col("o_orderkey").cast("string")).alias("request_id"),
                          (F.col("o_custkey") + 1).cast("string").alias("tenant_id"),
                          F.col("o_orderkey").cast("string").alias("app_id"))
    missing = supplier.select(F.concat(F.lit("missing:"), F.col("s_suppkey").cast("string")).alias("request_id"),
                              F.col("s_suppkey").cast("string").alias("tenant_id"),
                              F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("app_id"))
    return own.unionByName(other).unionByName(missing)


def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application ids to look up: part keys (mostly known ids) and unknown supplier ids."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    gone = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("id"))
    return parts.unionByName(gone)


def policy(spark: SparkSession, sf_dir: str):
    from rollscope.operators.tenant import TenantPolicy
    return TenantPolicy("true", patterns(spark, sf_dir), exclusions(spark, sf_dir))
