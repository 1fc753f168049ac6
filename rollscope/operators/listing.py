"""Application listing: status, time range, completed view, order and limits.

Applications: ``id, name, attempts ARRAY<STRUCT<attemptId, startTime, endTime,
completed>>`` with the newest attempt first.  Predicates over attempts are
higher-order array functions evaluated inside the scan's projection -- no
explode, no shuffle.  Two notions of "completed" exist and are kept apart:
the status filter calls an application running if *any* attempt is not
completed; the completed view looks at the newest attempt only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS_COMPLETED = "completed"
STATUS_RUNNING = "running"

# --- Fixed values: default bounds of the time-range query ---
DEFAULT_MIN_DATE = dt.datetime(2010, 1, 1)
DEFAULT_MAX_DATE = dt.datetime(3000, 1, 1)
# ---------------------------------------------------------------


def ts_lit(value) -> Column:
    """A timestamp parameter as a zone-free literal (results do not depend on the session zone)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def any_running(attempts: Column | str = "attempts") -> Column:
    """True if any attempt is not completed (false for no attempts)."""
    a = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.coalesce(F.exists(a, lambda x: ~x["completed"]), F.lit(False))


def head_attempt(field: str, attempts: str = "attempts") -> Column:
    return F.get(F.col(attempts), 0).getField(field)


def filter_status(apps: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Keep applications whose status is requested; no statuses = both."""
    statuses = [s.lower() for s in (statuses or [])]
    inc_completed = not statuses or STATUS_COMPLETED in statuses
    inc_running = not statuses or STATUS_RUNNING in statuses
    running = any_running()
    return apps.where((~running & F.lit(inc_completed)) | (running & F.lit(inc_running)))


def time_range_predicate(min_date=DEFAULT_MIN_DATE, max_date=DEFAULT_MAX_DATE,
                         min_end_date=DEFAULT_MIN_DATE, max_end_date=DEFAULT_MAX_DATE,
                         now=None) -> Column:
    """Some attempt started within [min, max] and ended within [min_end, max_end].

    For a running application (any attempt open) the end test is instead
    ``max_end_date > now``, for all of its attempts.  ``now`` is a parameter so
    that results are reproducible.
    """
    now = ts_lit(now if now is not None else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    lo, hi, elo, ehi = ts_lit(min_date), ts_lit(max_date), ts_lit(min_end_date), ts_lit(max_end_date)
    running = any_running()

    def ok(a):
        start_ok = (a["startTime"] >= lo) & (a["startTime"] <= hi)
        end_ok = ((running & (ehi > now))
                  | (~running & (a["endTime"] >= elo) & (a["endTime"] <= ehi)))
        return start_ok & end_ok

    return F.coalesce(F.exists(F.col("attempts"), ok), F.lit(False))


def filter_time_range(apps: DataFrame, min_date=DEFAULT_MIN_DATE, max_date=DEFAULT_MAX_DATE,
                      min_end_date=DEFAULT_MIN_DATE, max_end_date=DEFAULT_MAX_DATE,
                      now=None) -> DataFrame:
    return apps.where(time_range_predicate(min_date, max_date, min_end_date, max_end_date, now))


def is_completed(attempts: str = "attempts") -> Column:
    """Completed view: attempts not empty and the newest one completed."""
    return F.coalesce(head_attempt("completed", attempts), F.lit(False))


def completed_view(apps: DataFrame, show_incomplete: bool = False) -> DataFrame:
    return apps.where(is_completed() != F.lit(show_incomplete))


def listing_order() -> list[Column]:
    """Newest end time first (newest attempt), applications without one last, then id."""
    return [head_attempt("endTime").desc_nulls_last(), F.col("id").asc()]


def order_listing(apps: DataFrame) -> DataFrame:
    return apps.orderBy(*listing_order())


def limit_listing(apps: DataFrame, n: int | None = None) -> DataFrame:
    """First n in listing order; None = all, n <= 0 = none.

    ``orderBy(...).limit(n)`` plans as a top-k per partition plus a merge of
    k rows per partition, never a full sort.
    """
    ordered = order_listing(apps)
    if n is None:
        return ordered
    return ordered.limit(max(int(n), 0))


def cap(apps: DataFrame, k: int, partition_by: str | None = None) -> DataFrame:
    """At most k applications, overall or per ``partition_by`` (e.g. tenant).

    The per-group form is ``row_number() <= k``, which Spark plans with a
    partial group limit before the shuffle, so a tenant holding a third of
    all rows ships at most k rows per map task.
    """
    if partition_by is None:
        return limit_listing(apps, k)
    w = Window.partitionBy(partition_by).orderBy(*listing_order())
    return apps.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def app_lookup(apps: DataFrame, ids: DataFrame) -> DataFrame:
    """Application of each requested id; NULL columns when unknown."""
    return ids.join(apps, "id", "left")


def visible_views(apps: DataFrame, tenants: DataFrame, policy) -> DataFrame:
    """Per tenant: ``has_completed`` / ``has_incomplete`` -- is there anything to show
    in the completed view and in the incomplete view.

    Exempt applications count for every tenant (two global flags, scalar
    subqueries); the rest comes from the tenant's pattern pairs, built once
    for both views.
    """
    from rollscope.operators import tenant as tn
    done = is_completed()
    t = tenants.select("tenant_id").distinct()
    if not policy.filtering:
        c = apps.select(F.coalesce(F.bool_or(done), F.lit(False))).scalar()
        i = apps.select(F.coalesce(F.bool_or(~done), F.lit(False))).scalar()
        return t.select("tenant_id", c.alias("has_completed"), i.alias("has_incomplete"))
    exempt, _ = tn.exclusion_split(apps, policy)
    ex_c = exempt.select(F.coalesce(F.bool_or(done), F.lit(False))).scalar()
    ex_i = exempt.select(F.coalesce(F.bool_or(~done), F.lit(False))).scalar()
    flags = apps.select(F.col("id").alias("app_id"), done.alias("_done"))
    own = (tn.access_matrix(apps, tenants, policy).select("app_id", "tenant_id").join(flags, "app_id")
           .groupBy("tenant_id").agg(F.bool_or("_done").alias("_c"), F.bool_or(~F.col("_done")).alias("_i")))
    j = t.join(own, t["tenant_id"].eqNullSafe(own["tenant_id"]), "left").drop(own["tenant_id"])
    return j.select("tenant_id",
                    (ex_c | F.coalesce(F.col("_c"), F.lit(False))).alias("has_completed"),
                    (ex_i | F.coalesce(F.col("_i"), F.lit(False))).alias("has_incomplete"))


def has_visible_apps(apps: DataFrame, tenants: DataFrame, policy, show_incomplete: bool = False
                     ) -> DataFrame:
    """Per tenant: is there any application to show in the chosen view."""
    col = "has_incomplete" if show_incomplete else "has_completed"
    return visible_views(apps, tenants, policy).select("tenant_id", F.col(col).alias("has_visible"))


def flatten_attempts(apps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per attempt (a NULL attempt row for applications without any)."""
    keep = keep or ["id", "name"]
    return apps.select(*keep, F.posexplode_outer("attempts").alias("attempt_idx", "a")).select(
        *keep, "attempt_idx", "a.attemptId", "a.startTime", "a.endTime", "a.completed")


def application_query(apps: DataFrame, tenant: str | None, policy, statuses: list[str] | None = None,
                      min_date=DEFAULT_MIN_DATE, max_date=DEFAULT_MAX_DATE,
                      min_end_date=DEFAULT_MIN_DATE, max_end_date=DEFAULT_MAX_DATE,
                      limit: int | None = None, now=None) -> DataFrame:
    """The listing a tenant gets back: tenant filter, status, time range, order, limit."""
    from rollscope.operators import tenant as tn
    listed = tn.tenant_listing(apps, tenant, policy)
    kept = filter_time_range(filter_status(listed, statuses), min_date, max_date, min_end_date,
                             max_end_date, now)
    return limit_listing(kept, limit)


def tenant_summary(apps: DataFrame, tenant: str | None, policy, show_incomplete: bool = False,
                   max_apps: int | None = None) -> DataFrame:
    """Summary page of one tenant: the chosen view, in listing order; at most ``max_apps`` if given.

    Empty result = nothing to display (the page shows its "none found" text).
    """
    from rollscope.operators import tenant as tn
    view = completed_view(tn.tenant_listing(apps, tenant, policy), show_incomplete)
    return limit_listing(view, None) if max_apps is None else cap(view, max_apps)
