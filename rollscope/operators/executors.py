"""Executors linked to their logs: pod names, log links, rewritten log maps.

Executor table: ``app_id, id, isActive, executorLogs MAP<STRING,STRING>`` plus
any number of pass-through fields.  The application *name* (not id) goes
into the link, because log directories are named after applications.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.functions.columns import LOG_LINK_KEY, log_url, pod_id


def with_app(executors: DataFrame, apps: DataFrame) -> DataFrame:
    """Application name of every executor row: one equi join instead of a lookup per row.

    No broadcast hint: the application table grows with history; AQE
    broadcasts it when its runtime size is under the threshold.
    """
    names = apps.select(F.col("id").alias("app_id"), F.col("name").alias("app_name"))
    return executors.join(names, "app_id", "left")


def with_log_url(df: DataFrame, proxy_base: str = "", encode: bool = False) -> DataFrame:
    """``pod`` and ``log_url`` for rows that carry ``id`` and ``app_name``."""
    return (df.withColumn("pod", pod_id(F.col("id")))
            .withColumn("log_url", log_url(F.col("app_name"), F.col("pod"), proxy_base, encode)))


def replace_executor_logs(df: DataFrame) -> DataFrame:
    """Replace the whole log map with ``{logs: log_url}``; all other fields kept."""
    return df.withColumn("executorLogs", F.create_map(F.lit(LOG_LINK_KEY), F.col("log_url")))


def executors_of(executors: DataFrame, active_only: bool = False) -> DataFrame:
    return executors.where(F.col("isActive")) if active_only else executors


def executor(executors: DataFrame, executor_id: str) -> DataFrame:
    """The rows of one executor id."""
    return executors.where(F.col("id") == F.lit(executor_id))


def executor_links(executors: DataFrame, apps: DataFrame, proxy_base: str = "",
                   active_only: bool = False, encode: bool = False) -> DataFrame:
    """Executors of every application with links pointing at the log service."""
    chosen = executors_of(executors, active_only)
    return replace_executor_logs(with_log_url(with_app(chosen, apps), proxy_base, encode))


def executor_by_id(requests: DataFrame, executors: DataFrame, apps: DataFrame, proxy_base: str = "",
                   encode: bool = False) -> DataFrame:
    """One executor of one application for each request (app_id, executor_id), its link pointing at the log service.

    Executor ids repeat between applications, so both keys are joined; a request that names none keeps NULLs.
    """
    linked = executor_links(executors, apps, proxy_base, encode=encode)
    linked = linked.select(F.col("app_id").alias("_app"), *(c for c in linked.columns if c != "app_id"))
    return requests.join(linked, (F.col("app_id") == F.col("_app")) & (F.col("executor_id") == F.col("id")), "left").drop("_app")
