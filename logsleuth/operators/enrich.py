"""Per-event compliance records (J4, A7, PF17–PF20, SC12, ST1 body).

Stateless and row-local: entity extraction (F6), per-entity base scores from
a small parameter table (a literal map, no join), the risk level, the
recommendations and the attention flag are all expressions on the event row,
so the same function serves batch and streaming and never shuffles.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import entities as OE

# Per-type base scores as the handler applies them (T8: it
# tests 'iam_role', which no extracted entity carries, so roles score 0.5).
ENTITY_BASE_SCORES = {"iam_role": 0.3, "ip_address": 0.4, "vpc_id": 0.2}
DEFAULT_BASE_SCORE = 0.5
SCORE_FACTORS = ["entity_rarity", "context_analysis"]
SCORE_THRESHOLD = 5.0
ATTENTION_SCORE = 7.0
PROCESSOR_VERSION = "1.0.0"
# Recommendation texts.
REC_HIGH_RISK = "Review high-risk entities for potential security violations"
REC_IAM = "Verify IAM role permissions align with least-privilege principles"
REC_IP = "Validate source IP addresses against allowed network ranges"
REC_NONE = "No immediate compliance actions required"


def _lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def anomaly_scores(entities: Column, base_scores: dict | None = None) -> Column:
    """One score struct per entity (base score by type, default 0.5)."""
    table = _lit_map(ENTITY_BASE_SCORES if base_scores is None else base_scores)
    facs = F.array(*[F.lit(f) for f in SCORE_FACTORS])
    return F.transform(entities, lambda e: F.struct(
        F.coalesce(F.element_at(table, e["entity_type"]), F.lit(DEFAULT_BASE_SCORE)).alias("score"),
        facs.alias("factors"), F.lit(SCORE_THRESHOLD).alias("threshold"),
        (F.coalesce(F.element_at(table, e["entity_type"]), F.lit(DEFAULT_BASE_SCORE))
         >= F.lit(SCORE_THRESHOLD)).alias("is_anomaly")))


def risk_level(scores: Column) -> Column:
    """PF18: max >= 8 or mean >= 6 → high; max >= 6 or mean >= 4 → medium;
    else (and when empty) low."""
    vals = F.transform(scores, lambda s: s["score"])
    mx = F.array_max(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals)
    return (F.when(F.size(vals) == 0, "low")
             .when((mx >= 8.0) | (mean >= 6.0), "high")
             .when((mx >= 6.0) | (mean >= 4.0), "medium")
             .otherwise("low"))


def recommendations(entities: Column, scores: Column) -> Column:
    """PF19: texts in fixed order; the default text when none applies."""
    recs = F.array_compact(F.array(
        F.when(F.exists(scores, lambda s: s["score"] >= 0.7), F.lit(REC_HIGH_RISK)),
        F.when(F.exists(entities, lambda e: e["entity_type"].isin("iam_role_arn", "iam_user_arn")),
               F.lit(REC_IAM)),
        F.when(F.exists(entities, lambda e: e["entity_type"] == "ip_address"), F.lit(REC_IP))))
    return F.when(F.size(recs) == 0, F.array(F.lit(REC_NONE))).otherwise(recs)


def enrich_cloudtrail(events: DataFrame, base_scores: dict | None = None) -> DataFrame:
    """Compliance record per valid audit event (ComplianceOutput shape)."""
    x = OE.cloudtrail_entities(events, "entities")
    x = x.withColumn("anomaly_scores", anomaly_scores(F.col("entities"), base_scores))
    vals = F.transform("anomaly_scores", lambda s: s["score"])
    return x.select(
        F.col("eventID").alias("log_id"), F.lit("cloudtrail").alias("event_source"),
        F.col("eventTime").alias("timestamp"),
        F.transform("entities", lambda e: e.dropFields("ord")).alias("entities"),
        F.coalesce(F.array_max(vals), F.lit(0.0)).alias("risk_score"),
        risk_level(F.col("anomaly_scores")).alias("risk_level"),
        F.col("anomaly_scores"),
        recommendations(F.col("entities"), F.col("anomaly_scores")).alias("recommendations"),
        F.exists("anomaly_scores", lambda s: s["score"] >= ATTENTION_SCORE).alias("requires_attention"),
        F.current_timestamp().alias("processed_at"),
        F.lit(PROCESSOR_VERSION).alias("processor_version"))


def results_summary(results: DataFrame, status_col: str = "status") -> DataFrame:
    """SC12 / A22: totals over routed messages (see
    :func:`logsleuth.sources.cloudtrail.route_messages`): a record that fails
    its checks is an error, a skipped body counts nowhere, one bad message never
    fails its batch."""
    s = F.col(status_col)
    return results.agg(F.count_if(s != "skipped").alias("total_events"),
                       F.count_if(s == "valid").alias("successful_results"),
                       F.count_if(s.isin("rejected", "invalid")).alias("errors"))


def error_records(routed: DataFrame) -> DataFrame:
    """SC12: one ``{error, event_id, processed_at}`` row per failed message."""
    return (routed.where(F.col("status").isin("rejected", "invalid"))
                  .select(F.concat_ws("; ", "errors").alias("error"),
                          F.coalesce("eventID", F.lit("unknown")).alias("event_id"),
                          F.current_timestamp().alias("processed_at")))


def write_results(routed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SC12 sink: compliance rows, error rows and the summary as JSON lines in
    ``results``, ``errors`` and ``summary`` under ``path``.  The messages are read and
    parsed once, into the shared checkpoint folder; the three outputs read the
    parsed rows, so their totals agree whatever is lost or tried again."""
    routed = cut_lineage(routed)
    enrich_cloudtrail(routed.where(F.col("status") == "valid")).write.mode(mode).json(f"{path}/results")
    error_records(routed).write.mode(mode).json(f"{path}/errors")
    results_summary(routed).withColumn("processed_at", F.current_timestamp()).write.mode(mode).json(f"{path}/summary")
