"""Network flow-record scan (SC4, PF2, F15, T10, T11).

Default-format lines: whitespace-separated, at least 14 fields (extra fields
ignored); eight integer fields; window start/end are epoch seconds (UTC).
Bad lines become reject rows with a reason instead of being lost; lines whose
integer fields hold the ``-`` placeholder of NODATA/SKIPDATA records are
rejected with reason ``no_data``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field order of the default flow-record format.
FLOW_FIELDS = ["version", "account_id", "interface_id", "srcaddr", "dstaddr", "srcport",
               "dstport", "protocol", "packets", "bytes", "windowstart", "windowend",
               "action", "flowlogstatus"]
INT_FIELDS = {"version": "int", "srcport": "int", "dstport": "int", "protocol": "int",
              "packets": "bigint", "bytes": "bigint", "windowstart": "bigint", "windowend": "bigint"}
MIN_FIELDS = 14


def _parse_lines(lines: DataFrame, keep, line_col: str, num_col: str | None) -> DataFrame:
    t = F.trim(F.col(line_col))
    x = lines.where(t != "").withColumn("_f", F.split(t, r"\s+"))
    casts = {}
    for i, name in enumerate(FLOW_FIELDS):
        raw = F.try_element_at(F.col("_f"), F.lit(i + 1))
        casts[name] = raw.try_cast(INT_FIELDS[name]) if name in INT_FIELDS else raw
    n = F.size("_f")
    int_bad = None
    for name in INT_FIELDS:
        b = casts[name].isNull()
        int_bad = b if int_bad is None else (int_bad | b)
    has_dash = F.exists(F.slice(F.col("_f"), 1, MIN_FIELDS), lambda v: v == "-")
    reason = (F.when(n < MIN_FIELDS, F.format_string("Insufficient fields (%d < 14)", n))
               .when(int_bad & has_dash, F.lit("no_data"))
               .when(int_bad, F.lit("Parse error - invalid integer")))
    cols = [casts[nm].alias(nm) for nm in FLOW_FIELDS if nm not in ("windowstart", "windowend")]
    cols += [F.timestamp_seconds(casts["windowstart"]).alias("windowstart"),
             F.timestamp_seconds(casts["windowend"]).alias("windowend")]
    extra = [F.col(num_col).alias("line_number")] if num_col else []
    return x.select(*keep, *extra, *cols, F.col(line_col).alias("raw_line"), reason.alias("error"))


def parse_flow_text(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """Whole-file text → one row per non-blank line (header skipped when the
    stripped file starts with ``version``) with parsed fields and ``error``."""
    keep = [c for c in raw.columns if c not in (text_col, "file_size")]
    lines = raw.select(*keep, F.posexplode(F.split(F.trim(F.col(text_col)), "\n")).alias("_n", "_l"))
    lines = lines.where(~((F.col("_n") == 0) & F.col("_l").startswith("version")))
    lines = lines.withColumn("_n", F.col("_n") + 1)
    return _parse_lines(lines, keep, "_l", "_n")


def parse_flow_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Line-oriented variant for large splittable files: header lines are
    recognised by content (``version`` prefix)."""
    keep = [c for c in lines.columns if c != line_col]
    lines = lines.where(~F.trim(F.col(line_col)).startswith("version"))
    return _parse_lines(lines, keep, line_col, None)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error", "raw_line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())
