"""Audit-event JSON scan with conformance checks (SC3, SC5, SC10, SC11,
SC14, PF1, PF3, PF4, F14, F21).

A file holds ``{"Records": [...]}``, a bare list, or one object.  Parsing is
done on the VARIANT type: ``try_parse_json`` never fails (a broken file gives
a NULL and becomes a file-level reject), records are exploded from the
variant array, and every field is read with its JSON type checked, so a
number where a string is required is a reject, not a silent cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import explode_rows

# Required / optional string fields of an audit event.
REQUIRED_STRINGS = ["eventVersion", "eventSource", "eventName", "awsRegion", "requestID",
                    "eventID", "eventType", "recipientAccountId"]
OPTIONAL_STRINGS = ["sourceIPAddress", "userAgent", "sharedEventID", "vpcEndpointId"]
DICT_FIELDS = ["requestParameters", "responseElements", "serviceEventDetails"]
IDENTITY_OPTIONAL = ["principalId", "arn", "accountId", "userName"]

EVENT_SOURCES = ["cloudtrail", "vpc_flow", "s3_access", "iam"]
RISK_LEVELS = ["low", "medium", "high", "critical"]


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """The field as STRING when its JSON type is string, else NULL."""
    x = _get(v, path)
    return F.when(_vtype(x) == "STRING", F.variant_get(x, "$", "string"))


def _type_error(v: Column, path: str, name: str, required: bool) -> Column:
    x = _get(v, path)
    missing = x.isNull() | (_vtype(x) == "VOID")
    bad = ~missing & (_vtype(x) != "STRING")
    if required:
        return F.when(missing, F.lit(f"{name}: field required")).when(
            bad, F.lit(f"{name}: input should be a valid string"))
    return F.when(bad, F.lit(f"{name}: input should be a valid string"))


def records_of(doc: Column) -> Column:
    """``array<variant>`` of records: a list as is, ``Records`` of an object
    when present, else the object itself; NULL for unparsable input."""
    arr = F.try_variant_get(doc, "$", "array<variant>")
    recs = F.try_variant_get(doc, "$.Records", "array<variant>")
    is_obj = _vtype(doc).startswith("OBJECT")
    has_records = _get(doc, "$.Records").isNotNull()
    return (F.when(doc.isNull(), F.lit(None))
             .when(arr.isNotNull(), arr)
             .when(is_obj & has_records, recs)
             .when(is_obj, F.array(doc)))


def parse_records(recs: DataFrame, rec_col: str = "record") -> DataFrame:
    """PF1: typed audit-event columns plus an ``errors`` array (empty = valid)."""
    r = F.col(rec_col)
    ts_raw = _get(r, "$.eventTime")
    ts = F.when(_vtype(ts_raw) == "STRING",
                F.try_to_timestamp(F.variant_get(ts_raw, "$", "string")))
    ui = _get(r, "$.userIdentity")
    ui_obj = _vtype(ui).startswith("OBJECT")
    errors = [_type_error(r, f"$.{f}", f, True) for f in REQUIRED_STRINGS]
    errors += [_type_error(r, f"$.{f}", f, False) for f in OPTIONAL_STRINGS]
    errors.append(F.when(ts_raw.isNull() | (_vtype(ts_raw) == "VOID"), F.lit("eventTime: field required"))
                   .when(ts.isNull(), F.lit("eventTime: input should be a valid datetime")))
    errors.append(F.when(ui.isNull() | (_vtype(ui) == "VOID"), F.lit("userIdentity: field required"))
                   .when(~ui_obj, F.lit("userIdentity: input should be a valid dictionary")))
    errors.append(F.when(ui_obj, _type_error(ui, "$.type", "userIdentity.type", True)))
    errors += [F.when(ui_obj, _type_error(ui, f"$.{f}", f"userIdentity.{f}", False))
               for f in IDENTITY_OPTIONAL]
    for f in DICT_FIELDS:
        x = _get(r, f"$.{f}")
        errors.append(F.when(x.isNotNull() & (_vtype(x) != "VOID") & ~_vtype(x).startswith("OBJECT"),
                             F.lit(f"{f}: input should be a valid dictionary")))
    identity = F.struct(
        _string(ui, "$.type").alias("type"),
        *[_string(ui, f"$.{f}").alias(f) for f in IDENTITY_OPTIONAL],
        F.when(_vtype(_get(ui, "$.sessionContext")).startswith("OBJECT"),
               _get(ui, "$.sessionContext")).alias("sessionContext"))
    cols = [_string(r, f"$.{f}").alias(f) for f in REQUIRED_STRINGS]
    cols += [ts.alias("eventTime"), identity.alias("userIdentity")]
    cols += [_string(r, f"$.{f}").alias(f) for f in OPTIONAL_STRINGS]
    cols += [F.when(_vtype(_get(r, f"$.{f}")).startswith("OBJECT"), _get(r, f"$.{f}")).alias(f)
             for f in DICT_FIELDS]
    keep = [c for c in recs.columns if c != rec_col]
    return recs.select(*keep, *cols, F.array_compact(F.array(*errors)).alias("errors"))


def parse_cloudtrail_text(raw: DataFrame, text_col: str = "value", lines: bool = False) -> DataFrame:
    """SC3: whole-file (or, with ``lines=True``, JSON-lines, T14) text →
    one row per record with ``line_index`` (0 for whole files), ``record_index``
    (place inside the file or line), typed fields and ``errors``; an unparsable
    file or line yields one row with ``record_index`` NULL and an error."""
    keep = [c for c in raw.columns if c != text_col]
    if lines:
        src = raw.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("_l", "_txt")) \
                 .select(*keep, F.col("_l").cast("long").alias("_ln"), "_txt") \
                 .where(F.trim("_txt") != "")
        docs = src.select(*keep, "_ln", F.try_parse_json("_txt").alias("_doc"))
    else:
        docs = raw.select(*keep, F.lit(0).cast("long").alias("_ln"), F.try_parse_json(F.col(text_col)).alias("_doc"))
    docs = docs.withColumn("_recs", records_of(F.col("_doc")))
    bad = docs.where(F.col("_recs").isNull()).select(
        *keep, F.col("_ln").alias("line_index"), F.lit(None).cast("int").alias("record_index"), F.lit(None).cast("variant").alias("record"),
        F.array(F.lit("Invalid JSON in CloudTrail log")).alias("_file_errors"))
    good = explode_rows(docs.where(F.col("_recs").isNotNull()), "_recs", "record",
                        keep=keep + ["_ln"], with_pos="_i")
    good = good.select(*keep, F.col("_ln").alias("line_index"), F.col("_i").alias("record_index"),
                       "record", F.array().cast("array<string>").alias("_file_errors"))
    parsed = parse_records(good.unionByName(bad), "record")
    return (parsed.withColumn("errors", F.concat("_file_errors", "errors"))
                  .drop("_file_errors", "record"))


def parse_split_records(records: DataFrame) -> DataFrame:
    """SC3 for files of any size: the rows of :func:`~logsleuth.sources.records.split_records`
    as :func:`parse_cloudtrail_text` gives them."""
    rows = records.select("path", F.lit(0).cast("long").alias("line_index"), "record_index", "record",
                          F.array_compact(F.array("error")).alias("_file_errors"))
    return parse_records(rows, "record").withColumn("errors", F.concat("_file_errors", "errors")).drop("_file_errors")


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") == 0).drop("errors")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") > 0)


def queue_messages(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """SC10/PF17: queue payloads → one row per record, none lost, with
    ``record``, ``record_index`` and ``status``:

    - ``{"Records": [{"body": "<event json>"}, ...]}``: one row per body;
      ``skipped`` when the body has no non-empty ``eventSource`` (the handler
      drops it silently), ``rejected`` when it is not JSON, else ``valid``;
    - ``{"log_data": {...}}``: a direct call, one row, ``valid`` or ``invalid``
      when it has no ``eventSource``;
    - any other object: one ``invalid`` row (``Invalid event format``);
    - text that is not a JSON object: one ``rejected`` row.
    """
    keep = [c for c in messages.columns if c != text_col]
    doc = F.col("_doc")
    recs = F.try_variant_get(doc, "$.Records", "array<variant>")
    row = lambda rec, kind: F.struct(rec.cast("variant").alias("record"), F.lit(kind).alias("kind"))
    nothing = F.lit(None).cast("variant")
    direct = _get(doc, "$.log_data")
    parts = (F.when(doc.isNull() | ~F.coalesce(_vtype(doc).startswith("OBJECT"), F.lit(False)),
                    F.array(row(nothing, "broken")))
              .when(recs.isNotNull(), F.transform(recs, lambda r: row(
                  F.try_parse_json(F.try_variant_get(r, "$.body", "string")), "body")))
              .when(_get(doc, "$.Records").isNotNull(), F.array(row(nothing, "broken")))
              .when(direct.isNotNull(), F.array(row(direct, "direct")))
              .otherwise(F.array(row(nothing, "other"))))
    out = messages.select(*keep, F.try_parse_json(F.col(text_col)).alias("_doc")) \
                  .select(*keep, F.posexplode(parts).alias("record_index", "_p")) \
                  .select(*keep, "record_index", "_p.record", "_p.kind")
    src = F.try_variant_get("record", "$.eventSource", "string")
    has_source = F.coalesce(src != "", F.lit(False))
    status = (F.when((F.col("kind") == "broken") | ((F.col("kind") == "body") & F.col("record").isNull()), "rejected")
               .when(has_source, "valid").when(F.col("kind") == "body", "skipped").otherwise("invalid"))
    return out.withColumn("status", status).drop("kind")


def route_messages(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """PF17/A22: :func:`queue_messages` with the records parsed and checked;
    ``status`` becomes ``rejected`` for a record that fails PF1, with its
    ``errors``.  Rows keep every status, so each can go to its own sink."""
    parsed = parse_records(queue_messages(messages, text_col), "record")
    failed = (F.col("status") == "valid") & (F.size("errors") > 0)
    errors = (F.when(F.col("status").isin("valid"), F.col("errors"))
               .when(F.col("status") == "rejected", F.array(F.lit("Invalid JSON in message")))
               .when(F.col("status") == "invalid", F.array(F.lit("Invalid event format")))
               .otherwise(F.array().cast("array<string>")))
    return parsed.withColumn("errors", errors).withColumn("status", F.when(failed, "rejected").otherwise(F.col("status")))


def detect_format(raw: DataFrame, text_col: str = "value", path_col: str = "path") -> DataFrame:
    """SC5: ``event_source`` per file from the path hint, else the first 1000
    characters (JSON → audit; any of the first 5 lines with >= 14 fields and a
    numeric first field → flow), else audit."""
    p = F.lower(F.col(path_col))
    sample = F.trim(F.substring(F.col(text_col), 1, 1000))
    looks_json = (sample.startswith("{") | sample.startswith("[")) & F.try_parse_json(sample).isNotNull()
    lines = F.slice(F.split(sample, "\n"), 1, 5)
    flow_line = F.exists(lines, lambda ln: (F.size(F.split(F.trim(ln), r"\s+")) >= 14)
                         & (F.trim(ln) != "")
                         & F.split(F.trim(ln), r"\s+")[0].rlike(r"^[0-9]+$"))
    src = (F.when(p.contains("cloudtrail"), "cloudtrail")
            .when(p.contains("vpc") | p.contains("flow"), "vpc_flow")
            .when(looks_json, "cloudtrail")
            .when(flow_line, "vpc_flow")
            .otherwise("cloudtrail"))
    return raw.withColumn("event_source", src)


def domain_violations(df: DataFrame, checks: dict) -> DataFrame:
    """PF3/PF4: rows violating range or enum constraints, one row per
    violation: ``checks`` maps column -> (lo, hi) or a list of allowed values."""
    out = None
    for col, rule in checks.items():
        c = F.col(col)
        if isinstance(rule, tuple):
            bad = ~c.between(rule[0], rule[1])
            msg = f"{col} outside [{rule[0]}, {rule[1]}]"
        else:
            bad = ~c.isin(list(rule))
            msg = f"{col} not in domain"
        part = df.where(bad).withColumn("violation", F.lit(msg))
        out = part if out is None else out.unionByName(part)
    return out
