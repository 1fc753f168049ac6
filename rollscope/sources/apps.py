"""Application listings stored as JSON lines or Parquet, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("attemptId", T.StringType(), True),
    T.StructField("startTime", T.TimestampNTZType(), True),
    T.StructField("endTime", T.TimestampNTZType(), True),
    T.StructField("completed", T.BooleanType(), True),
])

APPLICATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("attempts", T.ArrayType(ATTEMPT_SCHEMA, True), True),
])


def read_applications(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The listing as a table with nested attempts (newest first); no schema inference."""
    reader = spark.read.schema(APPLICATION_SCHEMA)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def write_applications(apps: DataFrame, path: str, fmt: str = "json") -> None:
    """Store a listing; written whole with overwrite, so a retried job rewrites the same data."""
    w = apps.select(*[f.name for f in APPLICATION_SCHEMA.fields]).write.mode("overwrite")
    if fmt == "json":
        w.option("compression", "gzip").json(path)
    else:
        w.parquet(path)
