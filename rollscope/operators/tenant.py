"""Tenant visibility: which tenant may list / open which application.

Rule (listing): with filtering on, an application is visible to tenant ``t``
if its name is one of the exclusions, or -- when the exclusion list is not
empty -- it starts with ``pattern + t`` for some pattern.  An empty exclusion
list hides everything from the listing, while the single-application access
check lets everything through (two separate functions on purpose).
A NULL tenant is spelled ``null`` when glued to a pattern.

Patterns and exclusions may come from settings (comma lists, split as the JVM
splits) or as DataFrames of any size: all matching is done with equi joins.
Prefix tests become joins on exploded prefixes whose lengths are bounded by
the shortest / longest key (scalar subqueries, no collect to the driver).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscope.functions.columns import java_split, latest_attempt, scala_str

FILTERING_ON = "true"

REASON_EXCLUSION = "exclusion"
REASON_PATTERN = "pattern"
REASON_UNFILTERED = "filtering_disabled"

INLINE_PATTERNS = 64  # up to so many patterns are tested in the row, more are joined

DECISION_OK = "ok"
DECISION_FORBIDDEN = "forbidden"
DECISION_NOT_FOUND = "not_found"


@dataclass
class TenantPolicy:
    """Filtering flag plus patterns / exclusions (lists or one-column DataFrames)."""

    enabled: str = FILTERING_ON
    patterns: list[str] | DataFrame = field(default_factory=lambda: [""])
    exclusions: list[str] | DataFrame = field(default_factory=lambda: [""])

    @classmethod
    def from_settings(cls, enabled: str | None = None, patterns: str | None = None,
                      exclusions: str | None = None) -> "TenantPolicy":
        """From setting strings; absent settings take the defaults ("true", "", "")."""
        return cls(enabled if enabled is not None else FILTERING_ON,
                   java_split(patterns if patterns is not None else ""),
                   java_split(exclusions if exclusions is not None else ""))

    @property
    def filtering(self) -> bool:
        # exact comparison: "TRUE" or " true" switch filtering off
        return self.enabled == FILTERING_ON

    def patterns_df(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.patterns, DataFrame):
            return self.patterns.select(F.col(self.patterns.columns[0]).cast("string").alias("pattern"))
        return spark.createDataFrame([(p,) for p in self.patterns], "pattern string")

    def short_patterns(self, spark: SparkSession) -> list[str] | None:
        """The distinct patterns when there are at most ``INLINE_PATTERNS``, else None; no more than that is collected."""
        if isinstance(self.patterns, DataFrame):
            few = self.patterns_df(spark).where("pattern IS NOT NULL").distinct().limit(INLINE_PATTERNS + 1).collect()
            found = sorted(r.pattern for r in few)
        else:
            found = sorted({p for p in self.patterns if p is not None})
        return found if len(found) <= INLINE_PATTERNS else None

    def exclusions_df(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.exclusions, DataFrame):
            return self.exclusions.select(F.col(self.exclusions.columns[0]).cast("string").alias("name"))
        return spark.createDataFrame([(e,) for e in self.exclusions], "name string")


def tenant_key(tenant: Column) -> Column:
    return scala_str(tenant)


def prefix_join(left: DataFrame, text: str, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Pairs (left row, right row) where ``right[key]`` is a prefix of ``left[text]``.

    Each left row is exploded into its prefixes of the lengths that keys have
    (a scalar subquery: one short array), then equi-joined.  Fan-out per row is
    bounded by the number of distinct key lengths, and the join is a plain hash
    / sort-merge join that AQE may turn into a broadcast join when the key side
    proves small at runtime.
    """
    lengths = right.select(F.collect_set(F.length(key))).scalar()
    n = F.length(F.col(text))
    ex = (left.withColumn("_plen", F.explode(lengths)).where(F.col("_plen") <= n)
          .withColumn("_prefix", F.col(text).substr(F.lit(1), F.col("_plen"))))
    return ex.join(right, ex["_prefix"] == right[key], how).drop("_prefix", "_plen")


def _starts_with_any(text: Column, patterns: list[str], suffix: Column) -> Column:
    """Does ``text`` start with one of the patterns followed by ``suffix``?"""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.startswith(F.concat(F.lit(p), suffix))
    return hit


def exclusion_split(apps: DataFrame, policy: TenantPolicy, spark: SparkSession | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """(exempt, subject): applications named in the exclusions, and the others."""
    spark = spark or apps.sparkSession
    ex = policy.exclusions_df(spark).distinct().withColumnRenamed("name", "_ex_name")
    on = F.col("name") == F.col("_ex_name")
    return apps.join(ex, on, "left_semi"), apps.join(ex, on, "left_anti")


def _exclusions_nonempty(policy: TenantPolicy, spark: SparkSession) -> Column:
    return policy.exclusions_df(spark).select(F.count(F.lit(1)) > 0).scalar()


def tenant_listing(apps: DataFrame, tenant: str | None, policy: TenantPolicy) -> DataFrame:
    """Applications a tenant sees in the listing (identity when filtering is off)."""
    if not policy.filtering:
        return apps
    spark = apps.sparkSession
    exempt, subject = exclusion_split(apps, policy, spark)
    short = policy.short_patterns(spark)
    if short is not None:
        key = tenant_key(F.lit(tenant).cast("string"))
        hits = subject.where(_exclusions_nonempty(policy, spark) & _starts_with_any(F.col("name"), short, key))
        return exempt.unionByName(hits)
    keys = policy.patterns_df(spark).select(
        F.concat(F.col("pattern"), tenant_key(F.lit(tenant).cast("string"))).alias("k")).distinct()
    hits = prefix_join(subject.where(_exclusions_nonempty(policy, spark)), "name", keys, "k", "left_semi")
    return exempt.unionByName(hits)


def tenant_match(pairs: DataFrame, apps: DataFrame, policy: TenantPolicy) -> DataFrame:
    """Listing rule for (tenant_id, app_id) pairs: adds ``visible`` and ``reason``."""
    spark = pairs.sparkSession
    a = apps.select(F.col("id").alias("app_id"), "name")
    j = pairs.join(a, "app_id", "left")
    if not policy.filtering:
        return j.withColumn("visible", F.lit(True)).withColumn("reason", F.lit(REASON_UNFILTERED))
    j = _marked(j, policy, spark)
    excluded = F.coalesce(F.col("_excluded"), F.lit(False))
    by_pattern = _exclusions_nonempty(policy, spark) & F.coalesce(F.col("_hit"), F.lit(False))
    visible = F.col("name").isNotNull() & (excluded | by_pattern)
    reason = (F.when(~F.col("name").isNotNull(), F.lit(None))
              .when(excluded, F.lit(REASON_EXCLUSION))
              .when(by_pattern, F.lit(REASON_PATTERN)))
    return (j.withColumn("visible", visible).withColumn("reason", reason)
            .drop("_excluded", "_hit"))


def _marked(j: DataFrame, policy: TenantPolicy, spark: SparkSession) -> DataFrame:
    """``j`` with ``_excluded`` and ``_hit``: exclusion and pattern test of each row's own name and tenant.

    Decided per (tenant, name), never per request id, so repeated or NULL ids cannot share a decision.
    A short list of patterns is tested in the row. Rows without a name (unknown applications) are dealt by
    their id instead of meeting on one NULL key.
    """
    nameless = F.when(F.col("name").isNull(), F.pmod(F.xxhash64("app_id"), F.lit(1024))).otherwise(F.lit(0)).cast("int")
    ex = policy.exclusions_df(spark).distinct().select(
        F.col("name").alias("_ex_name"), F.lit(0).alias("_ex_deal"), F.lit(True).alias("_excluded"))
    named = j.withColumn("_deal", nameless)
    named = named.join(ex, (F.col("name") == F.col("_ex_name")) & (F.col("_deal") == F.col("_ex_deal")), "left").drop("_ex_name", "_ex_deal")
    short = policy.short_patterns(spark)
    if short is not None:
        return named.drop("_deal").withColumn("_hit", _starts_with_any(F.col("name"), short, tenant_key(F.col("tenant_id"))))
    pairs = named.where(F.col("name").isNotNull()).select("tenant_id", "name").distinct()
    cand = prefix_join(pairs, "name", policy.patterns_df(spark).distinct(), "pattern")
    hits = (cand.where(F.col("name").startswith(F.concat(F.col("pattern"), tenant_key(F.col("tenant_id")))))
            .select(F.col("tenant_id").alias("_tenant"), F.col("name").alias("_name")).distinct()
            .withColumns({"_hit": F.lit(True), "_hit_deal": F.lit(0)}))
    on = ((F.col("name") == F.col("_name")) & (F.col("_deal") == F.col("_hit_deal"))
          & F.col("tenant_id").eqNullSafe(F.col("_tenant")))
    return named.join(hits, on, "left").drop("_tenant", "_name", "_deal", "_hit_deal")


def tenant_access(requests: DataFrame, apps: DataFrame, policy: TenantPolicy) -> DataFrame:
    """Decision for opening one application: ``ok`` / ``forbidden`` / ``not_found``.

    ``requests``: request_id, tenant_id, app_id, optional attempt_id.  Unknown
    applications are not found; with filtering on, an empty exclusion list
    lets everything through, otherwise exclusions and patterns decide.  The
    attempt to open is the requested one, else the newest attempt's id.
    """
    spark = requests.sparkSession
    if "attempt_id" not in requests.columns:
        requests = requests.withColumn("attempt_id", F.lit(None).cast("string"))
    a = apps.select(F.col("id").alias("app_id"), "name", "attempts")
    j = requests.join(a, "app_id", "left")
    known = F.col("name").isNotNull() | F.col("attempts").isNotNull()
    attempt = latest_attempt(F.col("attempts"), F.col("attempt_id"))
    if not policy.filtering:
        decision = F.when(known, F.lit(DECISION_OK)).otherwise(F.lit(DECISION_NOT_FOUND))
        return j.select(*requests.columns, attempt.alias("resolved_attempt"), decision.alias("decision"))
    j = _marked(j, policy, spark)
    allowed = (~_exclusions_nonempty(policy, spark)
               | F.coalesce(F.col("_excluded"), F.lit(False))
               | F.coalesce(F.col("_hit"), F.lit(False)))
    decision = (F.when(~known, F.lit(DECISION_NOT_FOUND))
                .when(allowed, F.lit(DECISION_OK)).otherwise(F.lit(DECISION_FORBIDDEN)))
    return j.select(*requests.columns, attempt.alias("resolved_attempt"), decision.alias("decision"))


def access_matrix(apps: DataFrame, tenants: DataFrame, policy: TenantPolicy) -> DataFrame:
    """Every (application, tenant) pair made visible by a pattern, with a flag
    ``shared_prefix`` set when a longer tenant id also matches the same name
    through the same pattern (tenant "1" seeing "SEG-10-..." next to tenant "10").

    Two prefix joins: names against patterns, then the rest of each name
    against tenant ids.  Exempt applications are not paired with tenants here
    (they are visible to all; see ``access_audit``).
    """
    spark = apps.sparkSession
    _, subject = exclusion_split(apps, policy, spark)
    subject = subject.select(F.col("id").alias("app_id"), "name").where(_exclusions_nonempty(policy, spark))
    short = policy.short_patterns(spark)
    if short is not None:
        listed = F.array(*map(F.lit, short)) if short else F.array().cast("array<string>")
        hits = subject.withColumn("pattern", F.explode(F.filter(listed, lambda p: F.col("name").startswith(p))))
    else:
        hits = prefix_join(subject, "name", policy.patterns_df(spark).distinct(), "pattern")
    hits = (hits
            .withColumn("rest", F.expr("substring(name, length(pattern) + 1)")))
    t = tenants.select("tenant_id", tenant_key(F.col("tenant_id")).alias("tkey")).distinct()
    pairs = prefix_join(hits, "rest", t, "tkey").withColumn("tlen", F.length(tenant_key(F.col("tenant_id"))))
    # dealt once, by application; both steps then run over sorted rows, as nearly every pair is a group of its own
    # and a hash table of them would hold a task's whole share. By number: coalesced partitions would be sorted whole
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("app_id", "name", "pattern", "tenant_id", "tlen").repartition(parts, "app_id")
    longest = F.max("tlen").over(Window.partitionBy("app_id", "pattern"))
    pairs = pairs.select("app_id", "name", "tenant_id", (F.col("tlen") < longest).alias("shared"))
    one = Window.partitionBy("app_id", "name", "tenant_id")
    pairs = pairs.select("app_id", "name", "tenant_id", F.bool_or("shared").over(one).alias("shared_prefix"),
                         F.row_number().over(one.orderBy("tenant_id")).alias("_n"))
    return pairs.where("_n = 1").drop("_n")


def access_audit(apps: DataFrame, tenants: DataFrame, policy: TenantPolicy) -> DataFrame:
    """Who sees what in the listing: pattern pairs per tenant, plus each exempt
    application once with ``tenant_id`` NULL and reason ``exclusion`` (visible
    to all tenants), or every application once when filtering is off."""
    cols = ["app_id", "name", "tenant_id", "reason", "shared_prefix"]
    if not policy.filtering:
        return apps.select(F.col("id").alias("app_id"), "name", F.lit(None).cast("string").alias("tenant_id"),
                           F.lit(REASON_UNFILTERED).alias("reason"),
                           F.lit(None).cast("boolean").alias("shared_prefix"))
    exempt, _ = exclusion_split(apps, policy)
    ex_rows = exempt.select(F.col("id").alias("app_id"), "name",
                            F.lit(None).cast("string").alias("tenant_id"),
                            F.lit(REASON_EXCLUSION).alias("reason"),
                            F.lit(None).cast("boolean").alias("shared_prefix"))
    pat_rows = access_matrix(apps, tenants, policy).withColumn("reason", F.lit(REASON_PATTERN))
    return ex_rows.unionByName(pat_rows.select(*cols))
