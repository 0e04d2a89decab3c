"""Retention evaluation and recommendation reconciliation (J9, J10, J12,
J16, A17, A18, A24, PF16, SC17).

Bucket API probing is replaced by tables: a bucket-configuration table
(declared lifecycle, lock and encryption), an object inventory, and the
retention policy — a literal table of four tiers, broadcast by construction.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Retention policy by data tier (production settings).
RETENTION_POLICY = {
    "raw_security_logs": {"retention_years": 7, "immutable": True,
                          "lifecycle_transitions": [(30, "STANDARD_IA"), (365, "GLACIER"),
                                                    (1095, "DEEP_ARCHIVE")]},
    "compliance_outputs": {"retention_years": 5, "immutable": True,
                           "lifecycle_transitions": [(90, "STANDARD_IA"), (730, "GLACIER")]},
    "model_artifacts": {"retention_years": 3, "immutable": False,
                        "lifecycle_transitions": [(30, "STANDARD_IA"), (90, "GLACIER")]},
}
# Bucket-name keyword → tier (first match wins), defaults.
TIER_KEYWORDS = [("logs", "raw_security_logs"), ("compliance", "compliance_outputs"),
                 ("models", "model_artifacts")]
DATA_TIERS = ["raw_security_logs", "compliance_outputs", "model_artifacts", "operational_logs"]
DEFAULT_RETENTION_YEARS = 7
GRACE_DAYS = 30
COST_PER_GB_MONTH = 0.023
HIGH_COST_THRESHOLD = 1000.0
CRITICAL_KEYWORDS = ["encryption", "retention", "object lock"]
REC_REVIEW = "Review and address compliance issues in non-compliant buckets"
REC_COST = "Consider cost optimization for high storage costs"
TRANSITIONS_T = "array<struct<days:int,storage_class:string>>"


def policy_table(spark: SparkSession, policy: dict | None = None) -> DataFrame:
    """The policy as a small DataFrame (one row per tier)."""
    policy = RETENTION_POLICY if policy is None else policy
    rows = [(t, int(p.get("retention_years", DEFAULT_RETENTION_YEARS)), bool(p.get("immutable", False)),
             [(int(d), c) for d, c in p.get("lifecycle_transitions", [])]) for t, p in policy.items()]
    return spark.createDataFrame(rows, f"tier string, retention_years int, immutable boolean, "
                                       f"lifecycle_transitions {TRANSITIONS_T}")


def bucket_tier(bucket: Column, default_tier: str = "raw_security_logs") -> Column:
    """First keyword contained in the bucket name decides the tier
    (``default_tier``: raw logs in the report, operational logs in the
    single-bucket check, T20)."""
    out = None
    for kw, tier in TIER_KEYWORDS:
        out = F.when(bucket.contains(kw), tier) if out is None else out.when(bucket.contains(kw), tier)
    return out.otherwise(default_tier)


def storage_class_for_age(age_days: Column, transitions: Column) -> Column:
    """Storage class of an object of ``age_days`` under a transition
    list: the transition with the largest ``days <= age``, else STANDARD."""
    due = F.filter(transitions, lambda t: t["days"] <= age_days)
    best = F.aggregate(due, F.struct(F.lit(-1).alias("days"), F.lit("STANDARD").alias("storage_class")),
                       lambda a, t: F.when(t["days"] > a["days"], t).otherwise(a))
    return best["storage_class"]


def expiration_days(retention_years: Column, grace_days: int = GRACE_DAYS) -> Column:
    """Lifecycle expiration the policy applies: years x 365 + grace."""
    return retention_years * 365 + F.lit(grace_days)


def _attach_policy(df: DataFrame, policy: DataFrame, tier_col: str = "tier") -> DataFrame:
    # the policy table has a handful of rows: broadcast by construction
    p = policy.withColumnRenamed("tier", "_ptier")
    out = df.join(F.broadcast(p), df[tier_col] == p["_ptier"], "left").drop("_ptier")
    return (out.withColumn("retention_years", F.coalesce("retention_years", F.lit(DEFAULT_RETENTION_YEARS)))
               .withColumn("immutable", F.coalesce("immutable", F.lit(False)))
               .withColumn("lifecycle_transitions", F.coalesce(
                   "lifecycle_transitions", F.array().cast(TRANSITIONS_T))))


def validate_buckets(configs: DataFrame, policy: DataFrame,
                     default_tier: str = "raw_security_logs") -> DataFrame:
    """Declared configuration vs the tier policy per bucket.

    ``configs``: bucket, expiration_days (NULL with no transitions = no
    lifecycle rules), transitions, lock_enabled, lock_years, sse_algorithm.
    Output: tier, lifecycle / object-lock / encryption flags, ``issues``
    array and ``compliant``.
    """
    x = _attach_policy(configs.withColumn("tier", bucket_tier(F.col("bucket"), default_tier)), policy)
    req_days = F.col("retention_years") * 365
    trans = F.coalesce(F.col("transitions"), F.array().cast(TRANSITIONS_T))
    no_rules = F.col("expiration_days").isNull() & (F.size(trans) == 0)
    life = F.array_compact(F.array(
        F.when(no_rules, F.lit("No lifecycle rules configured")),
        F.when(~no_rules & F.col("expiration_days").isNotNull() & (F.col("expiration_days") < req_days),
               F.format_string("Retention period %d days is less than required %d days",
                               F.col("expiration_days"), req_days)),
        F.when(~no_rules & (F.size("lifecycle_transitions") > 0)
               & (F.size(trans) < F.size("lifecycle_transitions")),
               F.lit("Missing expected lifecycle transitions"))))
    lock = F.when(F.col("immutable"), F.array_compact(F.array(
        F.when(~F.coalesce(F.col("lock_enabled"), F.lit(False)), F.lit("Object Lock not enabled")),
        F.when(F.col("lock_years").isNotNull() & (F.col("lock_years") < F.col("retention_years")),
               F.format_string("Object Lock retention %d years is less than required %d years",
                               F.col("lock_years"), F.col("retention_years")))))
    ).otherwise(F.array().cast("array<string>"))
    enc = F.array_compact(F.array(
        F.when(F.col("sse_algorithm").isNull(), F.lit("No encryption configuration found"))
         .when(F.col("sse_algorithm") != "aws:kms", F.lit("KMS encryption not configured"))))
    out = x.select("bucket", "tier", "retention_years",
                   life.alias("_life"), lock.alias("_lock"), enc.alias("_enc"))
    return out.select(
        "bucket", "tier", (F.size("_life") == 0).alias("lifecycle_compliant"),
        (F.size("_lock") == 0).alias("object_lock_compliant"),
        (F.size("_enc") == 0).alias("encryption_compliant"),
        F.concat("_life", "_lock", "_enc").alias("issues"),
        (F.size(F.concat("_life", "_lock", "_enc")) == 0).alias("compliant"))


def storage_metrics(inventory: DataFrame) -> DataFrame:
    """Objects, bytes, per-class distribution and monthly cost per bucket."""
    per_class = inventory.groupBy("bucket", "storage_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    dist = per_class.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("storage_class", "n")))).alias("storage_class_distribution"))
    tot = inventory.groupBy("bucket").agg(F.count(F.lit(1)).alias("total_objects"),
                                          F.sum("size").alias("total_size_bytes"))
    tot = tot.withColumn("cost_estimate_monthly",
                         F.col("total_size_bytes") / F.lit(1024.0 ** 3) * COST_PER_GB_MONTH)
    return tot.join(dist, "bucket", "left")


def _critical(issues) -> Column:
    return F.filter(issues, lambda i: F.lower(i).rlike("|".join(CRITICAL_KEYWORDS)))


def critical_issues(validation: DataFrame) -> DataFrame:
    """The critical issues (about encryption, retention or object lock) of
    buckets that do not comply, one row each, so their number is not bound by one
    report row."""
    bad = validation.where(~F.col("compliant"))
    return bad.select("bucket", F.explode(_critical("issues")).alias("issue"))


def compliance_report(validation: DataFrame, metrics: DataFrame) -> DataFrame:
    """One summary row: totals, compliance rate, cost, TB, the number of
    critical issues (:func:`critical_issues` lists them) and recommendations."""
    x = validation.join(metrics, "bucket", "left")
    agg = x.agg(
        F.count(F.lit(1)).alias("total_buckets"), F.count_if("compliant").alias("compliant_buckets"),
        F.coalesce(F.sum("cost_estimate_monthly"), F.lit(0.0)).alias("total_cost_monthly"),
        F.coalesce(F.sum(F.col("total_size_bytes") / F.lit(1024.0 ** 4)), F.lit(0.0)).alias("total_size_tb"),
        F.coalesce(F.sum(F.when(~F.col("compliant"), F.size(_critical("issues")))), F.lit(0)).alias("n_critical_issues"))
    rate = F.when(F.col("total_buckets") > 0, F.col("compliant_buckets") / F.col("total_buckets")).otherwise(0.0)
    agg = agg.withColumn("compliance_rate", rate)
    recs = F.array_compact(F.array(F.when(F.col("compliance_rate") < 1.0, F.lit(REC_REVIEW)),
                                   F.when(F.col("total_cost_monthly") > HIGH_COST_THRESHOLD, F.lit(REC_COST))))
    return agg.withColumn("recommendations", recs)


# ----------------------------------------------------------- reconciliation

def open_recommendations(audit: DataFrame) -> DataFrame:
    """PF16: audit rows still in status RECOMMENDED."""
    return audit.where(F.col("status") == "RECOMMENDED")


def action_applied(audit: DataFrame) -> Column:
    """PF16: applied only when the flag is literally true."""
    return F.coalesce(F.col("applied") == F.lit(True), F.lit(False))


def reconcile(audit: DataFrame, reconciled_at: Column | None = None):
    """J12 + A18: mark open, applied recommendations RECONCILED.

    Returns ``(updated_audit, summary)``: the full table with the keyed
    update applied as a projection (write it back as a new snapshot, SC17),
    and ``scanned / reconciled / missing`` counts.
    """
    ts = F.current_timestamp() if reconciled_at is None else reconciled_at
    hit = (F.col("status") == "RECOMMENDED") & action_applied(audit)
    updated = (audit.withColumn("reconciled_at", F.when(hit, ts).otherwise(F.col("reconciled_at")))
                    .withColumn("status", F.when(hit, F.lit("RECONCILED")).otherwise(F.col("status"))))
    summary = audit.agg(F.count_if(F.col("status") == "RECOMMENDED").alias("scanned"),
                        F.count_if(hit).alias("reconciled"))
    summary = summary.withColumn("missing", F.col("scanned") - F.col("reconciled"))
    return updated, summary


def write_audit_snapshot(updated: DataFrame, path: str) -> None:
    """SC17: write the reconciled table as a new parquet snapshot."""
    updated.write.mode("overwrite").parquet(path)


# ------------------------------------------------------- versioned keyed table
# ``path/data/v=<version>/_bucket=<n>`` holds the rows of one bucket of the key as
# of a version, ``path/manifest/v=<version>`` one row per bucket with the version
# whose files are current.  Files are never changed; a version exists from the
# moment its manifest, one file, is committed.

AUDIT_BUCKETS = 64
_MANIFEST = "bucket int, version long"


def audit_versions(spark: SparkSession, path: str) -> list[int]:
    """SC17: the committed versions, oldest first."""
    try:
        seen = spark.read.schema(f"{_MANIFEST}, v long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["v"] for r in seen.select("v").distinct().collect())


def _current(spark, path, version):
    """Bucket number → version of its files; at most the number of buckets."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/v={version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _bucket_rows(spark, path, files, schema):
    paths = [f"{path}/data/v={v}/_bucket={b}" for b, v in sorted(files.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_audit(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """SC17: the table as of a version (the latest when not given)."""
    version = audit_versions(spark, path)[-1] if version is None else version
    return _bucket_rows(spark, path, _current(spark, path, version), schema)


def merge_audit(changes: DataFrame, path: str, key: str = "recommendation_id", buckets: int = AUDIT_BUCKETS) -> int:
    """SC17: replace the rows of ``changes`` by key, append new keys, and return the
    new version.  Only buckets with a changed key are written anew; the others stay
    as they are.  The manifest is committed last: until then, and after a run that
    stopped half way, readers see the version before.  The first call creates the
    table.  One writer at a time; ``changes`` has one row per key."""
    spark, schema = changes.sparkSession, changes.schema
    versions = audit_versions(spark, path)
    version = versions[-1] + 1 if versions else 0
    files = _current(spark, path, versions[-1]) if versions else {}
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = [r["b"] for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
    old = _bucket_rows(spark, path, {b: v for b, v in files.items() if b in touched}, schema)
    rest = old.join(changes.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    rows = rest.unionByName(changes).withColumn("_bucket", bucket)
    rows.repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={version}")
    files |= dict.fromkeys(touched, version)
    (spark.createDataFrame(sorted(files.items()), _MANIFEST).coalesce(1)
          .write.mode("overwrite").parquet(f"{path}/manifest/v={version}"))
    return version
