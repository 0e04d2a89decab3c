"""Entity extraction operators over DataFrames (F6, F7, A5, A6, U2, PF7).

Per-event work (extraction, event-level dedupe) stays inside the row as
arrays: no shuffle.  Only the batch-wide dedupe (A5) groups, on (type, id),
with ``max_by`` — a partial aggregate, so a hot entity is pre-combined on
every executor before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as FE
from ..functions.hof import explode_rows

ENTITY_COLS = ["entity_type", "entity_id", "confidence", "context", "source_field"]


def explode_entities(df: DataFrame, col: str = "entities", keep=()) -> DataFrame:
    """One row per entity: ``keep`` columns + entity fields (+ ``ord``)."""
    return explode_rows(df, col, "_e", keep, with_pos="_pos").select(*keep, "_e.*")


def text_entities(df: DataFrame, text_col: str = "text", keep=(), entity_types=None,
                  confidence_threshold: float = 0.7, source_field: str = "text_content") -> DataFrame:
    """F1–F4 + PF7 over a text column, exploded to entity rows."""
    out = FE.add_text_entities(df.select(*keep, text_col), text_col, "_ents", entity_types,
                               confidence_threshold, source_field)
    return explode_entities(out, "_ents", keep)


def _param_entities(params: Column, prefix: str) -> Column:
    """Entities from every top-level *string* value of a VARIANT object."""
    obj = F.coalesce(F.try_variant_get(params, "$", "map<string,variant>"),
                     F.create_map().cast("map<string,variant>"))
    kv = F.filter(F.map_entries(obj), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    per_key = F.transform(kv, lambda e: FE.with_source(
        FE.extract_from_text(F.variant_get(e["value"], "$", "string")),
        F.concat(F.lit(prefix + "."), e["key"])))
    return F.flatten(per_key)


def cloudtrail_entities(events: DataFrame, out_col: str = "entities") -> DataFrame:
    """identity ARN (routed + boosted), user name (user-ARN pattern),
    source IP (IP pattern), every top-level string of requestParameters and
    responseElements (all types), then event-level dedupe (A6).

    Expects the audit-event schema of :mod:`logsleuth.sources.cloudtrail`
    (``userIdentity`` struct, parameter objects as VARIANT).
    """
    ui = F.col("userIdentity")
    arn = F.nullif(ui["arn"], F.lit(""))
    user = F.nullif(ui["userName"], F.lit(""))
    ip = F.nullif(F.col("sourceIPAddress"), F.lit(""))
    empty = F.array().cast(f"array<{FE.ENTITY_STRUCT}>")
    parts = [
        F.when(arn.isNotNull(), FE.extract_from_arn(arn, "userIdentity.arn")).otherwise(empty),
        F.when(user.isNotNull(), FE.extract_from_text(user, ["iam_user_arn"],
                                                      source_field="userIdentity.userName")
               ).otherwise(empty),
        F.when(ip.isNotNull(), FE.extract_from_text(ip, ["ip_address"],
                                                    source_field="sourceIPAddress")).otherwise(empty),
    ]
    if "requestParameters" in events.columns:
        parts.append(F.coalesce(_param_entities(F.col("requestParameters"), "requestParameters"), empty))
    if "responseElements" in events.columns:
        parts.append(F.coalesce(_param_entities(F.col("responseElements"), "responseElements"), empty))
    tmp = events.withColumn("__raw_ents", F.concat(*parts))
    return tmp.withColumn(out_col, FE.dedupe_entities(F.col("__raw_ents"))).drop("__raw_ents")


def flow_entities(flows: DataFrame, out_col: str = "entities") -> DataFrame:
    """src/dst IP, the interface id read with the instance pattern (so
    ``eni-1235b8ca`` yields ``i-1235b8ca``), and a valid 12-digit account id
    as a role-typed proxy (confidence 0.95); then event-level dedupe."""
    acct = F.col("account_id")
    account = F.when(FE.is_valid_account_id(acct), F.array(F.struct(
        F.lit("iam_role_arn").alias("entity_type"), acct.alias("entity_id"),
        F.lit(0.95).alias("confidence"), F.concat(F.lit("AWS Account: "), acct).alias("context"),
        F.lit("account_id").alias("source_field"), F.lit(0).alias("ord")))).otherwise(
        F.array().cast(f"array<{FE.ENTITY_STRUCT}>"))
    parts = F.concat(
        FE.extract_from_text(F.coalesce(F.col("srcaddr"), F.lit("")), ["ip_address"], source_field="srcaddr"),
        FE.extract_from_text(F.coalesce(F.col("dstaddr"), F.lit("")), ["ip_address"], source_field="dstaddr"),
        FE.extract_from_text(F.coalesce(F.col("interface_id"), F.lit("")), ["ec2_instance_id"],
                             source_field="interface_id"),
        account)
    tmp = flows.withColumn("__raw_ents", parts)
    return tmp.withColumn(out_col, FE.dedupe_entities(F.col("__raw_ents"))).drop("__raw_ents")


def batch_dedupe(entities: DataFrame, order_cols=("event_seq", "ord")) -> DataFrame:
    """A5: one row per (type, id) with the highest confidence; ties go to
    the earliest row under ``order_cols``."""
    order_cols = list(order_cols)
    payload = F.struct(*[F.col(c) for c in entities.columns])
    rank_key = F.struct(F.col("confidence"), *[(-F.col(c)).alias(c) for c in order_cols])
    best = entities.groupBy("entity_type", "entity_id").agg(F.max_by(payload, rank_key).alias("_b"))
    return best.select("_b.*")
