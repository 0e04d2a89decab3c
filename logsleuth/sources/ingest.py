"""File ingest: format detection, parsing, per-file manifest and batch
summary (SC5–SC8, SC12, SC13, A10, A22).

The parsed rows are returned (the original counted them and dropped them);
the manifest is an aggregate over those rows, one row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cloudtrail as CT
from . import flowlogs as FL
from . import records as R
from .files import file_stem, large_files, only_listed, read_lines, read_listed, read_whole_files


def ingest_files(spark: SparkSession, paths, event_source: str | None = None,
                 bucket: str | None = None, max_files: int | None = None, whole_bytes: int = R.WHOLE_BYTES):
    """SC6/SC8 over many files at once, of any size.

    Returns ``(events, flows, manifest, errors)``: valid audit events, valid
    flow records (both with ``path``), one manifest row per file with
    ``batch_id`` (``s3-<bucket>-<key with / → ->`` when ``bucket`` is given,
    else ``local-<stem>``), ``event_source``, ``log_count``, ``size_bytes``
    (UTF-8 bytes of the decompressed text for object-store reads, bytes on
    disk for local reads) and its error count, and the error texts as rows.

    Files up to ``whole_bytes`` (less for compressed ones) are parsed in one piece.
    Larger ones are split at record boundaries, flow logs by line (their rows have
    no ``line_number``); their format comes from the path, else from the extension
    (``.log`` and ``.txt`` are flow logs), as no sample is read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if max_files is not None:
        paths = paths[:max_files]
    return _ingest(spark, paths, None, event_source, bucket, whole_bytes)


def ingest_listing(spark: SparkSession, root: str, listing: DataFrame, event_source: str | None = None,
                   bucket: str | None = None, whole_bytes: int = R.WHOLE_BYTES):
    """:func:`ingest_files` for a listing of any length (a DataFrame with
    ``path``, as :func:`~logsleuth.sources.files.list_log_files` gives)."""
    return _ingest(spark, [root], listing, event_source, bucket, whole_bytes)


def _large_format(path):
    """Format of a file that is too large for a sample."""
    p = F.lower(path)
    flow = p.contains("vpc") | p.contains("flow") | F.regexp_replace(p, R.COMPRESSED, "").rlike(r"\.(log|txt)$")
    return F.when(~p.contains("cloudtrail") & flow, "vpc_flow").otherwise("cloudtrail")


def _only(df: DataFrame, listing: DataFrame | None) -> DataFrame:
    return df if listing is None else only_listed(df, listing)


def _ingest(spark, paths, listing, event_source, bucket, whole_bytes):
    recursive = listing is not None
    whole = _only(read_whole_files(spark, paths, recursive, whole_bytes), listing)
    files, ct, fl = _parse_texts(whole, event_source)
    if not _only(large_files(spark, paths, recursive, whole_bytes), listing).isEmpty():
        kind = F.lit(event_source) if event_source else _large_format(F.col("path"))
        parts = _only(R.fragments(spark, paths, recursive, whole_bytes), listing).where(kind == "cloudtrail")
        lines = read_lines(spark, paths, recursive, whole_bytes)
        lines = _only(lines, listing).where(kind == "vpc_flow")
        texts = parts.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("n"), F.first("file_size").alias("file_size")) \
                     .unionByName(lines.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("n"),
                                                            F.first("file_size").alias("file_size")))
        files = files.unionByName(texts.select("path", kind.alias("event_source"), (F.col("n") - 1).alias("text_bytes"), "file_size"))
        ct = ct.unionByName(CT.parse_split_records(R.split_records(parts)), allowMissingColumns=True)
        fl = fl.unionByName(FL.parse_flow_lines(lines.drop("file_size")), allowMissingColumns=True)
    return _outputs(files, ct, fl, bucket)


def ingest_flow_listing(spark: SparkSession, root: str, listing: DataFrame):
    """Flow logs of a listing by line, so that large files are split over tasks:
    ``(flows, rejects)`` with ``path``."""
    lines = read_listed(spark, root, listing, wholetext=False).drop("file_size")
    parsed = FL.parse_flow_lines(lines)
    return FL.valid(parsed), FL.rejected(parsed)


def _parse_texts(raw: DataFrame, event_source: str | None):
    """Files, parsed audit records and parsed flow lines of ``path, value, file_size`` rows."""
    if event_source is None:
        raw = CT.detect_format(raw)
    else:
        raw = raw.withColumn("event_source", F.lit(event_source))
    ct = CT.parse_cloudtrail_text(raw.where(F.col("event_source") == "cloudtrail")
                                     .select("path", "value"))
    fl = FL.parse_flow_text(raw.where(F.col("event_source") == "vpc_flow").select("path", "value"))
    return raw.select("path", "event_source", F.octet_length("value").alias("text_bytes"), "file_size"), ct, fl


def ingest_texts(raw: DataFrame, event_source: str | None = None, bucket: str | None = None):
    """:func:`ingest_files` over ``path, value, file_size`` rows of whole files."""
    return _outputs(*_parse_texts(raw, event_source), bucket)


def _outputs(files: DataFrame, ct: DataFrame, fl: DataFrame, bucket: str | None):
    ct_counts = ct.groupBy("path").agg(F.count_if(F.size("errors") == 0).alias("log_count"),
                                       F.count_if(F.size("errors") > 0).alias("error_count"))
    fl_counts = fl.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("log_count"),
                                       F.count_if(F.col("error").isNotNull()).alias("error_count"))
    counts = ct_counts.unionByName(fl_counts)
    man = files.join(counts, "path", "left")
    key = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "")
    if bucket:
        batch_id = F.concat(F.lit(f"s3-{bucket}-"), F.translate(key, "/", "-"))
        size = F.col("text_bytes")
    else:
        batch_id = F.concat(F.lit("local-"), file_stem(F.col("path")))
        size = F.col("file_size")
    manifest = man.select(batch_id.alias("batch_id"), F.col("path").alias("source_key"),
                          "event_source", F.coalesce("log_count", F.lit(0)).alias("log_count"),
                          size.alias("size_bytes"),
                          F.coalesce("error_count", F.lit(0)).alias("error_count"),
                          F.current_timestamp().alias("created_at"))
    # error texts stay a long table (one row per rejected record / line), never a list per file
    errors = (ct.where(F.size("errors") > 0)
                .select("path", F.col("record_index").cast("long").alias("position"),
                        F.concat_ws("; ", "errors").alias("error"))
                .unionByName(fl.where(F.col("error").isNotNull())
                               .select("path", F.col("line_number").cast("long").alias("position"),
                                       F.concat(F.coalesce(F.concat(F.lit("Line "), F.col("line_number").cast("string"),
                                                                    F.lit(": ")), F.lit("")),
                                                F.col("error")).alias("error"))))
    return CT.valid(ct), FL.valid(fl), manifest, errors


def batch_summary(manifest: DataFrame) -> DataFrame:
    """SC7 / A10: totals over a manifest: files, events, files with errors,
    rejected records (the error texts are the long table from
    :func:`ingest_files`)."""
    return manifest.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("log_count").alias("total_events"),
        F.count_if(F.col("error_count") > 0).alias("files_with_errors"),
        F.sum("error_count").alias("rejected_records"))


def write_events(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """SC13: events as JSON lines (``jsonl`` / ``json``); other formats rejected."""
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"Unsupported format: {fmt}")
    df.write.mode(mode).json(path)


def read_json_documents(spark: SparkSession, paths, recursive: bool = False,
                        whole_bytes: int = R.WHOLE_BYTES) -> DataFrame:
    """SC11/SC14: JSON files of any size, each a list, a ``Records`` object or one
    object → parsed audit records (same recipe as SC3)."""
    parsed = CT.parse_cloudtrail_text(read_whole_files(spark, paths, recursive, whole_bytes).select("path", "value"))
    if large_files(spark, paths, recursive, whole_bytes).isEmpty():
        return parsed
    parts = R.fragments(spark, paths, recursive, whole_bytes)
    return parsed.unionByName(CT.parse_split_records(R.split_records(parts)))
