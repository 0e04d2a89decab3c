"""Registered queries over the driver tables and their SQL oracles.

Each query runs one of the library's operators on whole driver tables
(SURVEY §7.4 maps column roles: entity = ``user_id``, action =
``event_type``, ...).  ``ORACLE`` holds an independent SQL formulation that
DuckDB runs on the same parquet files; column names match and doubles are
rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hof import explode_rows
from .plans.spread import by_rows
from .session import cut_lineage
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --------------------------------------------------------------------------
# numeric series (W1, W2, W2b, W2c, A1, A2, PF9, PF10)
# --------------------------------------------------------------------------
from .operators import series as S  # noqa: E402

_EV_STATS = """
  SELECT event_type, median(value) AS med, mad(value) AS mad,
         avg(value) AS mean, stddev_pop(value) AS sd_pop, stddev_samp(value) AS sd_samp,
         count(*) AS n
  FROM events GROUP BY event_type"""

_W2_SCORE = """CASE WHEN s.mad <> 0 THEN abs(0.6745::DOUBLE * (e.value - s.med) / s.mad)
                    WHEN s.sd_pop <> 0 THEN abs((e.value - s.mean) / s.sd_pop)
                    ELSE 0.0 END"""


@register("series_mod_z_events", f"""
WITH s AS ({_EV_STATS}),
sc AS (SELECT e.event_id, e.event_type, e.value, {_W2_SCORE} AS raw FROM events e JOIN s USING (event_type))
SELECT event_id, event_type, value, round(raw, 6) AS score, round(raw, 9) >= 3.5 AS is_anomaly FROM sc
""")
def q_series_mod_z_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = S.detect_anomalies_mod_z(ev, "value", ["event_type"], threshold=3.5)
    return out.select("event_id", "event_type", "value", r6("score").alias("score"), "is_anomaly")


@register("series_mod_z_lineitem", """
WITH s AS (SELECT l_returnflag, median(l_extendedprice) AS med, mad(l_extendedprice) AS mad,
                  avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd_pop
           FROM lineitem GROUP BY l_returnflag),
sc AS (SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag,
              CASE WHEN s.mad <> 0 THEN abs(0.6745::DOUBLE * (l.l_extendedprice - s.med) / s.mad)
                   WHEN s.sd_pop <> 0 THEN abs((l.l_extendedprice - s.mean) / s.sd_pop)
                   ELSE 0.0 END AS raw
       FROM lineitem l JOIN s USING (l_returnflag))
SELECT l_orderkey, l_linenumber, l_returnflag, round(raw, 6) AS score,
       round(raw, 9) >= 3.5 AS is_anomaly FROM sc
""")
def q_series_mod_z_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                             "l_extendedprice")
    out = S.detect_anomalies_mod_z(li, "l_extendedprice", ["l_returnflag"], threshold=3.5)
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", r6("score").alias("score"),
                      "is_anomaly")


@register("series_stats_events", f"""
WITH s AS ({_EV_STATS})
SELECT event_type, n, round(med, 6) AS median, round(mad, 6) AS mad, round(mean, 6) AS mean,
       round(sd_pop, 6) AS std_pop, round(sd_samp, 6) AS std_samp FROM s
""")
def q_series_stats_events(spark, sf):
    ev = table(spark, sf, "events")
    st = S.series_stats(ev, "value", ["event_type"])
    return st.select("event_type", "n", *[r6(c).alias(c) for c in
                                           ("median", "mad", "mean", "std_pop", "std_samp")])


@register("series_detect_strict_events", f"""
WITH s AS ({_EV_STATS}),
sc AS (SELECT e.event_id, e.event_type, {_W2_SCORE} AS raw FROM events e JOIN s USING (event_type))
SELECT event_id, event_type, round(raw, 6) AS score, round(raw, 9) > 3.0 AS anomaly FROM sc
""")
def q_series_detect_strict_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = S.detect_anomalies(ev, "value", ["event_type"], threshold=3.0)
    return out.select("event_id", "event_type", r6("score").alias("score"), "anomaly")


@register("series_statistical_events", f"""
WITH s AS ({_EV_STATS}),
sc AS (SELECT e.event_id, e.event_type, s.n,
              CASE WHEN s.mad = 0 THEN 0.0 ELSE 0.6745::DOUBLE * (e.value - s.med) / s.mad END AS raw
       FROM events e JOIN s USING (event_type))
SELECT event_id, event_type, round(raw, 6) AS score,
       (n >= 3 AND round(abs(raw), 9) > 2.5) AS is_anomaly FROM sc
""")
def q_series_statistical_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = S.statistical_anomalies(ev, "value", ["event_type"], threshold=2.5)
    return out.select("event_id", "event_type", r6("score").alias("score"), "is_anomaly")


@register("series_standard_z_events", f"""
WITH s AS ({_EV_STATS}),
sc AS (SELECT e.event_id, e.event_type, s.n,
              CASE WHEN s.sd_samp = 0 THEN 0.0 ELSE (e.value - s.mean) / s.sd_samp END AS raw
       FROM events e JOIN s USING (event_type))
SELECT event_id, event_type, round(raw, 6) AS score,
       (n >= 3 AND round(abs(raw), 9) > 2.5) AS is_anomaly FROM sc
""")
def q_series_standard_z_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = S.statistical_anomalies(ev, "value", ["event_type"], threshold=2.5,
                                  use_modified_zscore=False)
    return out.select("event_id", "event_type", r6("score").alias("score"), "is_anomaly")


@register("series_anomalous_indices_events", f"""
WITH s AS ({_EV_STATS}),
sc AS (SELECT e.event_id, e.event_type, {_W2_SCORE} AS raw FROM events e JOIN s USING (event_type))
SELECT event_id, event_type, round(raw, 6) AS score, 'investigate_and_tag' AS action
FROM sc WHERE round(raw, 9) >= 3.0
""")
def q_series_anomalous_indices_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    hits = S.anomalous_indices_with_scores(ev, "value", ["event_type"], threshold=3.0)
    hits = hits.withColumn("is_anomaly", F.lit(True))
    rec = S.recommend_reconciliation(hits)
    return rec.select("event_id", "event_type", r6("score").alias("score"), "action")


@register("series_rolling_events", """
WITH w AS (
  SELECT event_id, user_id, value,
         median(value) OVER win AS med,
         avg(value) OVER win AS mean,
         stddev_pop(value) OVER win AS sd,
         list(value) OVER win AS vals
  FROM events
  WINDOW win AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT *, list_median(list_transform(vals, lambda v: abs(v - med))) AS mad FROM w)
SELECT event_id, user_id,
       round(CASE WHEN mad <> 0 THEN abs(0.6745::DOUBLE * (value - med) / mad)
                  WHEN sd <> 0 THEN abs((value - mean) / sd) ELSE 0.0 END, 6) AS score
FROM m
""")
def q_series_rolling_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out = S.windowed_modified_z_scores(ev, "value", ["user_id"], ["ts", "event_id"], window_size=5, segment_ts="ts")
    return out.select("event_id", "user_id", r6("score").alias("score"))


@register("series_rolling_wide_events", """
WITH w AS (
  SELECT event_id, event_type, value,
         median(value) OVER win AS med,
         avg(value) OVER win AS mean,
         stddev_pop(value) OVER win AS sd,
         list(value) OVER win AS vals
  FROM events
  WINDOW win AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND 500 FOLLOWING)),
m AS (SELECT *, list_median(list_transform(vals, lambda v: abs(v - med))) AS mad FROM w)
SELECT event_id, event_type,
       round(CASE WHEN mad <> 0 THEN abs(0.6745::DOUBLE * (value - med) / mad)
                  WHEN sd <> 0 THEN abs((value - mean) / sd) ELSE 0.0 END, 6) AS score
FROM m
""")
def q_series_rolling_wide_events(spark, sf):
    """W1 with windows of 1,001 rows over long series."""
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    out = S.windowed_modified_z_scores(ev, "value", ["event_type"], ["ts", "event_id"], window_size=1001, segment_ts="ts")
    return out.select("event_id", "event_type", r6("score").alias("score"))


# --------------------------------------------------------------------------
# entities (F1–F4, PF5, PF7, T5–T7, A5)
# --------------------------------------------------------------------------
from .functions import entities as FE  # noqa: E402
from .operators import entities as OE  # noqa: E402

# A text per customer that carries every entity shape, built with SQL that
# Spark and DuckDB evaluate identically (ids derived from the row's keys).
CUSTOMER_TEXT_SQL = (
    "concat('User arn:aws:iam::', lpad(CAST(c_custkey AS STRING), 12, '0'), ':user/u', "
    "CAST(c_custkey AS STRING), ' from ', CAST(c_custkey % 256 AS STRING), '.', "
    "CAST(c_nationkey AS STRING), '.', CAST((c_custkey * 7) % 300 AS STRING), '.', "
    "CAST(c_custkey % 97 AS STRING), ' assumed arn:aws:sts::', "
    "lpad(CAST(c_nationkey AS STRING), 12, '0'), ':assumed-role/R', CAST(c_nationkey AS STRING), "
    "'/s', CAST(c_custkey AS STRING), ' in vpc-', printf('%08x', c_custkey * 40503), "
    "' subnet-', printf('%010x', c_custkey * 7919), ' eni-', printf('%08x', c_custkey + 305419896), "
    "' sg-', printf('%09x', c_custkey * 31), ' key arn:aws:kms:us-east-1:', "
    "lpad(CAST(c_custkey AS STRING), 12, '0'), ':key/', printf('%08x', c_custkey), '-1234-abcd-9876-', "
    "printf('%012x', c_custkey * 65537), ' bucket s3://logs-', lower(c_mktsegment), "
    "' again ', CAST(c_custkey % 256 AS STRING), '.1.2.3 ', c_name)")


def _duck_entity_sql(src_sql: str, threshold: float = 0.7) -> str:
    """DuckDB formulation of text extraction (RE2, ASCII classes) for ``src(rid, text)``."""
    sel = []
    for ti, t in enumerate(FE.ENTITY_TYPES):
        for pi, p in enumerate(FE.ENTITY_PATTERNS[t]):
            rp = "(?i)" + p.replace("'", "''")
            sel.append(f"SELECT rid, text, '{t}' AS entity_type, {ti} AS ti, {pi} AS pi, "
                       f"regexp_extract_all(text, '{rp}') AS ms, "
                       f"string_split_regex(text, '{rp}') AS segs FROM src")
    union = "\n UNION ALL ".join(sel)
    return f"""
WITH src AS ({src_sql}),
m AS ({union}),
x AS (SELECT *, unnest(range(len(ms))) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT rid, text, entity_type, ti, pi, i, ms[i + 1] AS entity_id,
             (coalesce(list_sum(list_transform(segs[1:i + 1], lambda s: length(s))), 0)
             + coalesce(list_sum(list_transform(ms[1:i], lambda s: length(s))), 0))::BIGINT AS st
      FROM x),
q AS (SELECT *, st + length(entity_id) AS en,
             CASE WHEN entity_type = 'iam_role_arn' AND starts_with(entity_id, 'arn:aws:') THEN 0.95
                  WHEN entity_type = 'vpc_id' AND starts_with(entity_id, 'vpc-') THEN 0.9
                  WHEN entity_type = 's3_bucket' AND length(entity_id) >= 3 THEN 0.85
                  WHEN entity_type = 'kms_key_id' AND length(entity_id) = 36 THEN 0.9
                  WHEN entity_type = 'ec2_instance_id' AND starts_with(entity_id, 'i-') THEN 0.9
                  WHEN entity_type = 'ip_address' AND len(string_split(entity_id, '.')) = 4
                       AND list_bool_and(list_transform(string_split(entity_id, '.'),
                             lambda s: coalesce(TRY_CAST(s AS INTEGER) BETWEEN 0 AND 255, false)))
                       THEN 0.95
                  ELSE 0.7 END AS b0
      FROM p),
r AS (SELECT *, CASE WHEN length(entity_id) < 3 THEN b0 * 0.5 ELSE b0 END AS b1,
             lower(substring(text, greatest(st - 50, 0) + 1, en + 50 - greatest(st - 50, 0))) AS ctx
      FROM q),
s AS (SELECT *, round(CASE
          WHEN entity_type = 'iam_role_arn' AND (ctx LIKE '%role%' OR ctx LIKE '%user%'
               OR ctx LIKE '%policy%' OR ctx LIKE '%arn%') THEN least(1.0, b1 + 0.05)
          WHEN entity_type = 'ip_address' AND (ctx LIKE '%ip%' OR ctx LIKE '%address%'
               OR ctx LIKE '%source%' OR ctx LIKE '%destination%') THEN least(1.0, b1 + 0.05)
          ELSE b1 END, 3)::DOUBLE AS confidence,
          substring(text, greatest(st - 20, 0) + 1, en + 20 - greatest(st - 20, 0)) AS context,
          row_number() OVER (PARTITION BY rid, entity_type, entity_id ORDER BY ti, pi, i) AS occ
      FROM r),
k AS (SELECT * FROM s WHERE occ = 1 AND confidence >= {threshold})
SELECT rid, entity_type, entity_id, confidence, context,
       (row_number() OVER (PARTITION BY rid ORDER BY ti, pi, i) - 1)::INTEGER AS ord
FROM k"""


def _customer_texts(spark, sf):
    cust = by_rows(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"))
    return cust.selectExpr("c_custkey AS rid", f"{CUSTOMER_TEXT_SQL} AS text")


_CUST_SRC = f"SELECT c_custkey AS rid, {CUSTOMER_TEXT_SQL} AS text FROM customer"
_DOC_SRC = "SELECT doc_id AS rid, text FROM documents"


@register("entities_customer_text", _duck_entity_sql(_CUST_SRC))
def q_entities_customer_text(spark, sf):
    ents = OE.text_entities(_customer_texts(spark, sf), "text", keep=["rid"])
    return ents.select("rid", "entity_type", "entity_id", "confidence", "context", "ord")


@register("entities_documents_text", _duck_entity_sql(_DOC_SRC))
def q_entities_documents_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), "text")
    ents = OE.text_entities(docs, "text", keep=["rid"])
    return ents.select("rid", "entity_type", "entity_id", "confidence", "context", "ord")


@register("entities_customer_low_threshold", _duck_entity_sql(_CUST_SRC, 0.0))
def q_entities_customer_low_threshold(spark, sf):
    ents = OE.text_entities(_customer_texts(spark, sf), "text", keep=["rid"], confidence_threshold=0.0)
    return ents.select("rid", "entity_type", "entity_id", "confidence", "context", "ord")


@register("entities_batch_dedupe", f"""
WITH e AS ({_duck_entity_sql(_CUST_SRC, 0.0)}),
b AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id
                                   ORDER BY confidence DESC, rid, ord) AS k FROM e)
SELECT entity_type, entity_id, confidence, rid AS first_rid FROM b WHERE k = 1
""")
def q_entities_batch_dedupe(spark, sf):
    ents = OE.text_entities(_customer_texts(spark, sf), "text", keep=["rid"], confidence_threshold=0.0)
    best = OE.batch_dedupe(ents, order_cols=("rid", "ord"))
    return best.select("entity_type", "entity_id", "confidence", F.col("rid").alias("first_rid"))


# --------------------------------------------------------------------------
# behavioural engine (A3, A4, A8, A9, W3–W6, J2, J3, J5–J7, U1, PF21)
# --------------------------------------------------------------------------
from .operators import behavior as B  # noqa: E402

# Role mapping of the driver events: entity = user, action = event_type,
# source = props.k, region = k % 4.  Escalation patterns over event types
# (parameters of the operator; the audit-log defaults are in behavior.py).
EVENT_PATTERNS = {
    "signup_to_purchase": (["signup", "purchase"], 8.0),
    "error_then_purchase": (["error", "click", "purchase"], 9.0),
    "browse_and_buy": (["view", "click", "purchase"], 7.5),
}


def events_as_audit(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    uid = F.col("user_id").cast("string")
    return ev.select(
        "event_id", "ts", F.col("event_type").alias("action"), k.alias("source"),
        (k.cast("long") % 4).cast("string").alias("region"), uid.alias("user_key"),
        F.array(F.struct(F.lit("user").alias("entity_type"), uid.alias("entity_id"))).alias("entities"))


def events_entity_rows(spark, sf):
    a = events_as_audit(spark, sf)
    return a.select("event_id", "ts", "action", "source", "region", F.lit(0).alias("ent_ord"),
                    F.lit("user").alias("entity_type"), F.col("user_key").alias("entity_id"))


_EE_SQL = """ee AS (SELECT event_id, ts, 'user' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id,
                 event_type AS action, json_extract_string(props, '$.k') AS source,
                 CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR) AS region,
                 hour(ts) AS hr FROM events)"""


def _hist_str(m):
    return F.concat_ws(",", F.transform(F.map_entries(m), lambda e: F.concat_ws(
        ":", e["key"].cast("string"), e["value"].cast("string"))))


def _duck_profiles(source="ee"):
    return f"""
WITH {_EE_SQL},
e AS (SELECT * FROM {source}),
b AS (SELECT entity_type, entity_id, count(*) AS total_events, min(ts) AS first_seen, max(ts) AS last_seen,
             string_agg(DISTINCT action, ',' ORDER BY action) AS actions,
             count(DISTINCT source) AS n_sources FROM e GROUP BY ALL),
h AS (SELECT entity_id, string_agg(hr || ':' || c, ',' ORDER BY hr) AS hours
      FROM (SELECT entity_id, hr, count(*) AS c FROM e GROUP BY ALL) GROUP BY ALL),
g AS (SELECT entity_id, string_agg(region || ':' || c, ',' ORDER BY region) AS regions
      FROM (SELECT entity_id, region, count(*) AS c FROM e GROUP BY ALL) GROUP BY ALL)
SELECT * FROM b JOIN h USING (entity_id) JOIN g USING (entity_id)
"""


def profile_columns(p):
    """Profiles with their sets and histograms as text."""
    return p.select("entity_type", "entity_id", "total_events", "first_seen", "last_seen",
                    F.concat_ws(",", "unique_actions").alias("actions"), "n_sources",
                    _hist_str(F.col("time_patterns")).alias("hours"),
                    _hist_str(F.col("geo_patterns")).alias("regions"))


def _profiles_q(**options):
    def q(spark, sf):
        return profile_columns(B.entity_profiles(events_entity_rows(spark, sf), **options))
    return q


register("behavior_profiles_events", _duck_profiles())(_profiles_q())
# Profiles of the last week
register("behavior_profiles_lookback_events", _duck_profiles(
    "ee WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY"))(_profiles_q(lookback_days=7))


def _duck_behavior(mode: str, min_events: int = 10, lookback_days: int | None = None) -> str:
    if mode == "parity":
        n, hc = "n_incl", "h_incl"
        extra = ""
    else:
        n, hc = "(n_incl - 1)", "(h_incl - 1)"
        extra = f"""
UNION ALL
SELECT event_id, entity_id, 'behavioral_deviation' AS anomaly_type,
       CASE WHEN action IN ({",".join("'" + a + "'" for a in B.HIGH_RISK_ACTIONS)}) THEN 9.0
            WHEN action IN ({",".join("'" + a + "'" for a in B.MEDIUM_RISK_ACTIONS)}) THEN 6.0
            ELSE 4.0 END AS score, 0.7 AS confidence,
       'New action: ' || action || ' | No historical precedent' AS factors
FROM c WHERE {n} >= {min_events} AND a_incl = 1
UNION ALL
SELECT event_id, entity_id, 'behavioral_deviation', 6.0, 0.6,
       'New source IP: ' || source || ' | No historical precedent'
FROM c WHERE {n} >= {min_events} AND source IS NOT NULL AND source <> '' AND s_incl = 1"""
    counts = """c AS (SELECT *,
        count(*) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_incl,
        count(*) OVER (PARTITION BY entity_id, hr ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h_incl,
        count(*) OVER (PARTITION BY entity_id, action ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a_incl,
        count(*) OVER (PARTITION BY entity_id, source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s_incl
      FROM ee)"""
    if lookback_days is not None:
        counts = f"""c AS (SELECT a.event_id, a.entity_id, a.hr, a.action, a.source, count(*) AS n_incl, count(*) FILTER (b.hr = a.hr) AS h_incl,
        count(*) FILTER (b.action = a.action) AS a_incl, count(*) FILTER (b.source = a.source) AS s_incl
      FROM ee AS a JOIN ee AS b ON a.entity_id = b.entity_id AND b.ts > a.ts - INTERVAL {lookback_days} DAY
        AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id <= a.event_id)
      GROUP BY a.event_id, a.entity_id, a.hr, a.action, a.source)"""
    return f"""
WITH {_EE_SQL},
{counts},
r AS (
SELECT event_id, entity_id, 'time_pattern_anomaly' AS anomaly_type,
       least(8.0 - 100.0 * {hc} / {n}, 10.0) AS score, 0.8 AS confidence,
       printf('Unusual activity hour: %02d:00', hr) || ' | ' ||
       printf('Historical frequency: %.1f%%', 100.0 * {hc} / {n}) AS factors
FROM c WHERE {n} >= {min_events} AND {n} > 0 AND {hc} * 1.0 / {n} < 0.05 AND {hc} < 2{extra})
SELECT event_id, entity_id, anomaly_type, round(score, 6) AS score, confidence, factors FROM r"""


def _behavior_q(mode, **options):
    def q(spark, sf):
        a = B.behavioral_anomalies(events_entity_rows(spark, sf), mode=mode, **options)
        return a.select("event_id", "entity_id", "anomaly_type", r6("score").alias("score"),
                        "confidence", F.concat_ws(" | ", "factors").alias("factors"))
    return q


register("behavior_parity_events", _duck_behavior("parity"))(_behavior_q("parity"))
register("behavior_prior_events", _duck_behavior("prior"))(_behavior_q("prior"))
# Only the events of the last days count
register("behavior_lookback_events", _duck_behavior("prior", 5, 3))(_behavior_q("prior", min_events=5, lookback_days=3))
register("behavior_lookback_parity_events", _duck_behavior("parity", 5, 20))(_behavior_q("parity", min_events=5, lookback_days=20))


def orders_with_part_entities(spark, sf):
    """Events = orders; entities = distinct (brand, part) of its lines in line order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pt = table(spark, sf, "part").select("p_partkey", "p_brand")
    lp = li.join(pt, li.l_partkey == pt.p_partkey)
    ent = lp.groupBy("l_orderkey", "p_brand", "l_partkey").agg(F.min("l_linenumber").alias("ln"))
    per = ent.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ln", "p_brand", "l_partkey"))),
        lambda s: F.struct(s["p_brand"].alias("entity_type"),
                           s["l_partkey"].cast("string").alias("entity_id"))).alias("entities"))
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"),
                                           F.col("o_orderdate").alias("ts"),
                                           F.col("o_orderpriority").alias("action"))
    return od.join(per, od.event_id == per.l_orderkey, "left").drop("l_orderkey").withColumn(
        "entities", F.coalesce("entities", F.array().cast(
            "array<struct<entity_type:string,entity_id:string>>")))


_ORDER_PAIRS_SQL = """
li AS (SELECT l_orderkey, p_brand AS t, CAST(l_partkey AS VARCHAR) AS id, min(l_linenumber) AS ln
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
en AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln) AS pos FROM li),
ne AS (SELECT l_orderkey, count(*) AS k FROM en GROUP BY ALL),
ev AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, coalesce(k, 0) AS k,
              sum(CASE WHEN coalesce(k, 0) >= 2 THEN 1 ELSE 0 END)
                OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total
       FROM orders LEFT JOIN ne ON l_orderkey = o_orderkey),
pr AS (SELECT a.l_orderkey AS event_id, least(a.t, b.t) AS t1, greatest(a.t, b.t) AS t2, count(*) AS m
       FROM en a JOIN en b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos GROUP BY ALL),
pc AS (SELECT pr.*, ev.ts, ev.total,
              sum(m) OVER (PARTITION BY t1, t2 ORDER BY ev.ts, pr.event_id ROWS UNBOUNDED PRECEDING) AS cnt
       FROM pr JOIN ev USING (event_id))"""


@register("behavior_rare_pairs_orders", f"""
WITH {_ORDER_PAIRS_SQL},
hit AS (SELECT *, cnt * 1.0 / total AS f FROM pc WHERE total >= 100 AND cnt * 1.0 / total < 0.01)
SELECT event_id, t1 || '+' || t2 AS entity_id, round(least(10.0 * (1 - f / 0.01), 10.0), 6) AS score,
       round(1 - f, 6) AS baseline_deviation,
       printf('Frequency: %.4f', f) AS freq_factor
FROM hit, range(m)
""")
def q_behavior_rare_pairs_orders(spark, sf):
    ev = orders_with_part_entities(spark, sf)
    r = B.rare_combinations(ev)
    return r.select("event_id", "entity_id", r6("score").alias("score"),
                    r6("baseline_deviation").alias("baseline_deviation"),
                    F.col("factors")[1].alias("freq_factor"))


@register("behavior_combination_counts_orders", """
WITH li AS (SELECT l_orderkey, p_brand AS t, CAST(l_partkey AS VARCHAR) AS id, min(l_linenumber) AS ln
            FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
en AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln) AS pos,
              count(*) OVER (PARTITION BY l_orderkey) AS k FROM li),
ev AS (SELECT en.*, o_orderpriority AS a FROM en JOIN orders ON o_orderkey = l_orderkey WHERE k >= 2),
fam AS (
  SELECT 'types' AS family, printf('(''%s'', ''%s'')', least(x.t, y.t), greatest(x.t, y.t)) AS key
  FROM ev x JOIN ev y ON x.l_orderkey = y.l_orderkey AND x.pos < y.pos
  UNION ALL SELECT 'action', t || ':' || a FROM ev
  UNION ALL SELECT 'entity_action', id || ':' || a FROM ev)
SELECT family, key, count(*) AS count FROM fam GROUP BY ALL
""")
def q_behavior_combination_counts_orders(spark, sf):
    return B.combination_counts(orders_with_part_entities(spark, sf))


def _duck_escalation(lookback_minutes: int, patterns: dict | None = None) -> str:
    look = lookback_minutes * 60 * 1_000_000
    pats = []
    for rank, (name, (acts, base)) in enumerate((patterns or EVENT_PATTERNS).items()):
        lst = ", ".join(f"'{a}'" for a in acts)
        pats.append(f"SELECT {rank} AS prank, '{name}' AS pname, [{lst}] AS pacts, {base} AS base")
    return f"""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS act, epoch_us(ts) AS t FROM events),
w AS (SELECT a.event_id, a.u, a.t,
             list(b.act ORDER BY b.t, b.event_id) AS acts
      FROM e a JOIN e b ON a.u = b.u AND b.t > a.t - {look}
           AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id))
      GROUP BY ALL),
p AS ({" UNION ALL ".join(pats)})
SELECT w.event_id, w.u AS entity_id, pname,
       least(base + CASE WHEN len(acts) >= 3 THEN 1.0 ELSE 0.0 END, 10.0) AS score,
       'Recent actions: [' || array_to_string(list_transform(
           acts[greatest(len(acts) - 4, 1):len(acts)], lambda x: '''' || x || ''''), ', ') || ']'
         AS recent
FROM w, p WHERE list_has_all(acts, pacts)
"""


def _escalation_q(lookback_minutes):
    def q(spark, sf):
        a = events_as_audit(spark, sf)
        r = B.privilege_escalation(a, "user_key", "action", EVENT_PATTERNS, lookback_minutes)
        return r.select("event_id", "entity_id",
                        F.regexp_replace(F.col("factors")[0], "^Privilege escalation pattern: ", ""
                                         ).alias("pname"),
                        "score", F.regexp_replace(F.col("factors")[1], "^Recent actions: ", "Recent actions: "
                                                  ).alias("recent"))
    return q


register("behavior_escalation_events_24h", _duck_escalation(1440))(_escalation_q(1440))
register("behavior_escalation_events_30m", _duck_escalation(30))(_escalation_q(30))


# --------------------------------------------------------------------------
# engine + analyst reports (U1, J3, PF21, A8, A9, PF12–PF15, A11–A16, A21,
# A25, A26, SL1–SL3, J11, J14) — the events table scored in "prior" mode
# --------------------------------------------------------------------------
from .operators import analysis as AN  # noqa: E402

ENGINE_THRESHOLD = 2.5
ENGINE_LOOKBACK_MIN = 1440


def scored_events(spark, sf):
    a = events_as_audit(spark, sf)
    sc = B.score_events(a, mode="prior", threshold=ENGINE_THRESHOLD, patterns=EVENT_PATTERNS,
                        lookback_minutes=ENGINE_LOOKBACK_MIN)
    base = a.select("event_id", "ts", F.col("user_key").alias("user"), "action",
                    F.col("source").alias("source_ip"), "region", "entities",
                    F.lit(None).cast("string").alias("user_arn"),
                    F.lit(None).cast("string").alias("user_agent"))
    return B.aggregate_scores(base, sc)


def _duck_engine_ctes(patterns: dict | None = None, lookback_minutes: int = ENGINE_LOOKBACK_MIN,
                      threshold: float = ENGINE_THRESHOLD) -> str:
    hi = ",".join("'" + a + "'" for a in B.HIGH_RISK_ACTIONS)
    md = ",".join("'" + a + "'" for a in B.MEDIUM_RISK_ACTIONS)
    look = lookback_minutes * 60 * 1_000_000
    pats = " UNION ALL ".join(
        f"SELECT {r} AS prank, '{n}' AS pname, [{', '.join(repr(a) for a in acts)}] AS pacts, {b} AS base"
        for r, (n, (acts, b)) in enumerate((patterns or EVENT_PATTERNS).items()))
    return f"""{_EE_SQL},
c AS (SELECT *,
        count(*) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS n,
        count(*) OVER (PARTITION BY entity_id, hr ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS hc,
        count(*) OVER (PARTITION BY entity_id, action ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a_incl,
        count(*) OVER (PARTITION BY entity_id, source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s_incl
      FROM ee),
beh AS (
  SELECT event_id, 'time_pattern_anomaly' AS anomaly_type, least(8.0 - 100.0 * hc / n, 10.0) AS score,
         0 AS det_rank, 0 AS sub_rank,
         [printf('Unusual activity hour: %02d:00', hr),
          'Historical frequency: ' || printf('%.1f', 100.0 * hc / n) || '%'] AS factors
  FROM c WHERE n >= 10 AND hc * 1.0 / n < 0.05 AND hc < 2
  UNION ALL
  SELECT event_id, 'behavioral_deviation',
         CASE WHEN action IN ({hi}) THEN 9.0 WHEN action IN ({md}) THEN 6.0 ELSE 4.0 END, 0, 1,
         ['New action: ' || action, 'No historical precedent']
  FROM c WHERE n >= 10 AND a_incl = 1
  UNION ALL
  SELECT event_id, 'behavioral_deviation', 6.0, 0, 2, ['New source IP: ' || source, 'No historical precedent']
  FROM c WHERE n >= 10 AND source IS NOT NULL AND source <> '' AND s_incl = 1),
e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS act, epoch_us(ts) AS t FROM events),
w AS (SELECT a.event_id, list(b.act ORDER BY b.t, b.event_id) AS acts
      FROM e a JOIN e b ON a.u = b.u AND b.t > a.t - {look}
           AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id))
      GROUP BY ALL),
p AS ({pats}),
esc AS (SELECT w.event_id, 'privilege_escalation' AS anomaly_type,
               least(base + CASE WHEN len(acts) >= 3 THEN 1.0 ELSE 0.0 END, 10.0) AS score,
               2 AS det_rank, prank AS sub_rank,
               ['Privilege escalation pattern: ' || pname,
                'Recent actions: [' || array_to_string(list_transform(
                    acts[greatest(len(acts) - 4, 1):len(acts)], lambda x: '''' || x || ''''), ', ') || ']']
                 AS factors
        FROM w, p WHERE list_has_all(acts, pacts)),
allr AS (SELECT * FROM beh UNION ALL SELECT * FROM esc),
sw AS (SELECT *, least(wt, 10.0) AS score_w, wt >= {threshold} AS is_anom
       FROM (SELECT *, score * CASE anomaly_type WHEN 'behavioral_deviation' THEN 0.3
                                   WHEN 'time_pattern_anomaly' THEN 0.2
                                   WHEN 'privilege_escalation' THEN 0.4 ELSE 1.0 END AS wt FROM allr)),
agg AS (SELECT ev.event_id, ev.ts, CAST(ev.user_id AS VARCHAR) AS "user", ev.event_type AS action,
               json_extract_string(ev.props, '$.k') AS source_ip,
               CASE WHEN max(score_w) IS NULL THEN 0.0
                    ELSE least(max(score_w) * CASE WHEN count_if(is_anom) > 1
                                                   THEN 1 + 0.2 * (count_if(is_anom) - 1) ELSE 1 END, 10.0)
               END AS aggregate_score,
               coalesce(count_if(is_anom), 0) AS n_anomalies, count(sw.event_id) AS n_scores,
               max(CASE WHEN is_anom THEN score_w END) AS max_flagged,
               coalesce(flatten(list(factors ORDER BY det_rank, sub_rank) FILTER (WHERE is_anom)), [])
                 AS flagged_factors,
               coalesce(flatten(list(factors ORDER BY det_rank, sub_rank) FILTER (WHERE sw.event_id IS NOT NULL)), [])
                 AS all_factors
        FROM events ev LEFT JOIN sw USING (event_id) GROUP BY ev.event_id, ev.ts, ev.user_id,
             ev.event_type, ev.props),
an AS (SELECT * FROM agg WHERE aggregate_score >= {threshold})"""


def _dq(select_sql: str) -> str:
    return f"WITH {_duck_engine_ctes()}\n{select_sql}"


@register("engine_aggregate_events", _dq(
    "SELECT event_id, round(aggregate_score, 6) AS aggregate_score, n_anomalies, n_scores FROM agg"))
def q_engine_aggregate_events(spark, sf):
    s = scored_events(spark, sf)
    return s.select("event_id", r6("aggregate_score").alias("aggregate_score"), "n_anomalies", "n_scores")


@register("engine_weighted_scores_events", _dq("""
SELECT event_id, anomaly_type, round(score_w, 6) AS score, is_anom AS is_anomaly,
       array_to_string(factors, ' | ') AS factors FROM sw"""))
def q_engine_weighted_scores_events(spark, sf):
    a = events_as_audit(spark, sf)
    sc = B.score_events(a, mode="prior", threshold=ENGINE_THRESHOLD, patterns=EVENT_PATTERNS,
                        lookback_minutes=ENGINE_LOOKBACK_MIN)
    return sc.select("event_id", "anomaly_type", r6("score").alias("score"), "is_anomaly",
                     F.concat_ws(" | ", "factors").alias("factors"))


@register("engine_summary_orders", f"""
WITH {_ORDER_PAIRS_SQL},
fam AS (SELECT 'types' AS f, t1 || t2 AS k FROM pr
        UNION ALL SELECT 'action', en.t || ':' || o_orderpriority FROM en JOIN ne USING (l_orderkey)
             JOIN orders ON o_orderkey = en.l_orderkey WHERE ne.k >= 2
        UNION ALL SELECT 'entity_action', en.id || ':' || o_orderpriority FROM en JOIN ne USING (l_orderkey)
             JOIN orders ON o_orderkey = en.l_orderkey WHERE ne.k >= 2)
SELECT (SELECT count(*) FROM (SELECT DISTINCT t, id FROM en)) AS total_entity_profiles,
       (SELECT count(*) FROM ev WHERE k >= 2) AS total_combinations_observed,
       (SELECT count(DISTINCT o_custkey) FROM orders) AS active_users_tracked,
       (SELECT count(*) FROM (SELECT DISTINCT f, k FROM fam)) AS unique_combinations
""")
def q_engine_summary_orders(spark, sf):
    ev = orders_with_part_entities(spark, sf)
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"),
                                           F.col("o_custkey").cast("string").alias("user_key"))
    ev = ev.join(od, "event_id")
    return B.scoring_summary(ev)


@register("analysis_anomaly_summary_events", _dq("""
SELECT event_id, "user", action, round(aggregate_score, 6) AS aggregate_score,
       round(greatest(0.0, coalesce(max_flagged, 0.0)), 6) AS max_individual_score,
       len(flagged_factors) AS num_anomaly_factors,
       CASE WHEN len(flagged_factors) > 0 THEN array_to_string(flagged_factors[1:3], '; ')
            ELSE 'Unknown' END AS factors,
       hour(ts) AS hour, dayname(ts) AS day_of_week
FROM an"""))
def q_analysis_anomaly_summary_events(spark, sf):
    s = AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD)
    return s.select("event_id", "user", "action", r6("aggregate_score").alias("aggregate_score"),
                    r6("max_individual_score").alias("max_individual_score"), "num_anomaly_factors",
                    "factors", "hour", "day_of_week")


@register("analysis_by_user_events", _dq("""
SELECT "user", count(*) AS count, round_even(round(avg(aggregate_score), 9), 2) AS avg_score FROM an GROUP BY ALL"""))
def q_analysis_by_user_events(spark, sf):
    return AN.anomalies_by(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), "user")


@register("analysis_by_hour_events", _dq("""
SELECT hour(ts) AS hour, count(*) AS count, round_even(round(avg(aggregate_score), 9), 2) AS avg_score FROM an GROUP BY ALL"""))
def q_analysis_by_hour_events(spark, sf):
    return AN.anomalies_by(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), "hour")


@register("analysis_top_actions_events", _dq("""
SELECT action, count(*) AS count FROM an GROUP BY ALL ORDER BY count DESC, action LIMIT 10"""))
def q_analysis_top_actions_events(spark, sf):
    return AN.top_counts(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), "action", 10)


@register("analysis_top_sources_events", _dq("""
SELECT source_ip, count(*) AS count FROM an GROUP BY ALL ORDER BY count DESC, source_ip LIMIT 10"""))
def q_analysis_top_sources_events(spark, sf):
    return AN.top_counts(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), "source_ip", 10)


@register("analysis_top_anomalies_events", _dq("""
SELECT event_id, "user", round(aggregate_score, 6) AS aggregate_score FROM an
ORDER BY aggregate_score DESC, ts, event_id LIMIT 10"""))
def q_analysis_top_anomalies_events(spark, sf):
    t = AN.top_anomalies(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), 10)
    return t.select("event_id", "user", r6("aggregate_score").alias("aggregate_score"))


@register("analysis_histogram_events", _dq("""
SELECT * FROM (
  WITH r AS (SELECT CASE WHEN min(aggregate_score) = max(aggregate_score) THEN min(aggregate_score) - 0.5
                         ELSE min(aggregate_score) END AS l,
                    CASE WHEN min(aggregate_score) = max(aggregate_score) THEN max(aggregate_score) + 0.5
                         ELSE max(aggregate_score) END AS h FROM an),
  b AS (SELECT least(floor((aggregate_score - l) / ((h - l) / 20)), 19)::INTEGER AS bin FROM an, r),
  bins AS (SELECT range::INTEGER AS bin FROM range(20))
  SELECT bins.bin, round(l + bins.bin * (h - l) / 20, 6) AS bin_start,
         round(l + (bins.bin + 1) * (h - l) / 20, 6) AS bin_end, count(b.bin) AS count
  FROM bins CROSS JOIN r LEFT JOIN b ON b.bin = bins.bin GROUP BY ALL)"""))
def q_analysis_histogram_events(spark, sf):
    h = AN.score_histogram(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD), 20)
    return h.select("bin", r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"), "count")


@register("analysis_metrics_events", _dq(f"""
SELECT count(*) AS total_events, count_if(aggregate_score >= {ENGINE_THRESHOLD}) AS detected_anomalies,
       round(count_if(aggregate_score >= {ENGINE_THRESHOLD}) / count(*), 6) AS detection_rate,
       round(avg(aggregate_score), 6) AS mean_score, round(stddev_pop(aggregate_score), 6) AS std_score,
       round(median(aggregate_score), 6) AS median_score, round(max(aggregate_score), 6) AS max_score,
       round(min(aggregate_score), 6) AS min_score,
       count_if(aggregate_score >= {ENGINE_THRESHOLD}) AS scores_above_threshold,
       round(quantile_cont(aggregate_score, 0.95), 6) AS score_95th_percentile,
       round(quantile_cont(aggregate_score, 0.99), 6) AS score_99th_percentile,
       CASE WHEN count_if(aggregate_score >= {ENGINE_THRESHOLD}) / count(*) > 0.10 THEN 'raise_threshold'
            WHEN count_if(aggregate_score >= {ENGINE_THRESHOLD}) / count(*) < 0.01 THEN 'lower_threshold'
            ELSE 'well_calibrated' END AS rate_verdict,
       CASE WHEN stddev_pop(aggregate_score) < 1.0 THEN 'low_variance' ELSE 'good_variance' END
         AS variance_verdict
FROM agg"""))
def q_analysis_metrics_events(spark, sf):
    m = AN.detection_metrics(scored_events(spark, sf), ENGINE_THRESHOLD)
    dbl = ["detection_rate", "mean_score", "std_score", "median_score", "max_score", "min_score",
           "score_95th_percentile", "score_99th_percentile"]
    return m.select("total_events", "detected_anomalies", "scores_above_threshold",
                    *[r6(c).alias(c) for c in dbl], "rate_verdict", "variance_verdict")


@register("analysis_threshold_sweep_events", _dq("""
SELECT * FROM (
  WITH th AS (SELECT (1.0 + 0.5 * range)::DOUBLE AS threshold FROM range(18))
  SELECT threshold, count_if(aggregate_score >= threshold) AS anomaly_count,
         round(count_if(aggregate_score >= threshold) / count(*), 6) AS anomaly_rate,
         round(avg(aggregate_score), 6) AS avg_score
  FROM th CROSS JOIN agg GROUP BY threshold)"""))
def q_analysis_threshold_sweep_events(spark, sf):
    s = AN.threshold_sweep(scored_events(spark, sf))
    return s.select("threshold", "anomaly_count", r6("anomaly_rate").alias("anomaly_rate"),
                    r6("avg_score").alias("avg_score"))


@register("analysis_threshold_recommendation_events", _dq("""
SELECT * FROM (
  WITH th AS (SELECT (1.0 + 0.5 * range)::DOUBLE AS threshold FROM range(18)),
  s AS (SELECT threshold, count_if(aggregate_score >= threshold) AS anomaly_count,
               count_if(aggregate_score >= threshold) / count(*) AS anomaly_rate
        FROM th CROSS JOIN agg GROUP BY threshold)
  SELECT arg_min(threshold, (abs(anomaly_rate - 0.02), threshold)) AS recommended_threshold,
         round(arg_min(anomaly_rate, (abs(anomaly_rate - 0.02), threshold)), 6) AS recommended_rate,
         round(arg_min(anomaly_rate, (abs(threshold - 5.0), threshold)), 6) AS current_rate,
         arg_min(anomaly_count, (abs(threshold - 5.0), threshold)) AS current_count
  FROM s)"""))
def q_analysis_threshold_recommendation_events(spark, sf):
    r = AN.recommend_threshold(AN.threshold_sweep(scored_events(spark, sf)), current=5.0)
    return r.select("recommended_threshold", r6("recommended_rate").alias("recommended_rate"),
                    r6("current_rate").alias("current_rate"), "current_count")


@register("analysis_running_rate_events", _dq("""
SELECT * FROM (
  WITH o AS (SELECT event_id, ts, n_anomalies > 0 AS f,
                    row_number() OVER (ORDER BY ts, event_id) AS processed_events FROM agg),
  fs AS (SELECT "user", arg_min(event_id, (ts, event_id)) AS first_event FROM agg GROUP BY ALL),
  nw AS (SELECT first_event AS event_id, count(*) AS k FROM fs GROUP BY ALL),
  r AS (SELECT processed_events,
               sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (ORDER BY processed_events) AS a,
               sum(coalesce(k, 0)) OVER (ORDER BY processed_events) AS total_profiles
        FROM o LEFT JOIN nw USING (event_id))
  SELECT processed_events, round(a / processed_events, 6) AS anomaly_rate, total_profiles
  FROM r WHERE processed_events % 100 = 0)"""))
def q_analysis_running_rate_events(spark, sf):
    r = AN.running_anomaly_rate(scored_events(spark, sf), every=100)
    return r.select("processed_events", r6("anomaly_rate").alias("anomaly_rate"), "total_profiles")


@register("analysis_mode_events", _dq("""
SELECT (SELECT arg_min("user", (-n, "user")) FROM (SELECT "user", count(*) n FROM an GROUP BY ALL))
         AS most_anomalous_user,
       (SELECT arg_min(action, (-n, action)) FROM (SELECT action, count(*) n FROM an GROUP BY ALL))
         AS most_anomalous_action,
       (SELECT round(avg(aggregate_score), 6) FROM an) AS mean_score,
       (SELECT round(median(aggregate_score), 6) FROM an) AS median_score,
       (SELECT round(max(aggregate_score), 6) FROM an) AS max_score"""))
def q_analysis_mode_events(spark, sf):
    s = AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD)
    u = AN.mode_of(s, "user").withColumnRenamed("user", "most_anomalous_user")
    a = AN.mode_of(s, "action").withColumnRenamed("action", "most_anomalous_action")
    st = AN.summary_stats(s)
    return u.crossJoin(a).crossJoin(st).select(
        "most_anomalous_user", "most_anomalous_action", r6("mean_score").alias("mean_score"),
        r6("median_score").alias("median_score"), r6("max_score").alias("max_score"))


@register("analysis_investigation_context_events", _dq("""
SELECT event_id, count(*) OVER (PARTITION BY "user") AS user_anomalies,
       count(*) OVER (PARTITION BY action) AS action_anomalies,
       hour(ts) < 6 OR hour(ts) > 20 AS off_hours, hour(ts) BETWEEN 8 AND 18 AS business_hours,
       isodow(ts) >= 6 AS is_weekend,
       CASE WHEN aggregate_score > 8.0 THEN 'HIGH' WHEN aggregate_score > 6.0 THEN 'MEDIUM' ELSE 'LOW' END
         AS priority
FROM an"""))
def q_analysis_investigation_context_events(spark, sf):
    s = AN.investigation_context(AN.anomaly_summary(scored_events(spark, sf), ENGINE_THRESHOLD))
    return s.select("event_id", "user_anomalies", "action_anomalies", "off_hours", "business_hours",
                    "is_weekend", "priority")


@register("analysis_analyst_rows_events", _dq("""
SELECT row_number() OVER (ORDER BY ts, event_id) AS anomaly_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, "user" AS user_name, action AS event_name,
       source_ip, round(aggregate_score, 6) AS aggregate_score,
       len(all_factors) AS num_scoring_factors, array_to_string(all_factors, '; ') AS scoring_factors,
       'user:' || "user" AS entities_detected, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
       isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 8 AND 18 AS is_business_hours
FROM an"""))
def q_analysis_analyst_rows_events(spark, sf):
    r = AN.analyst_rows(scored_events(spark, sf), ENGINE_THRESHOLD)
    return r.select("anomaly_id", "timestamp", "user_name", "event_name", "source_ip",
                    r6("aggregate_score").alias("aggregate_score"), "num_scoring_factors",
                    "scoring_factors", "entities_detected", "hour_of_day", "day_of_week",
                    "is_weekend", "is_business_hours")


# --------------------------------------------------------------------------
# audit events derived from the driver events + enrichment (F5, F6, A6, J4,
# A7, PF18–PF20)
# --------------------------------------------------------------------------
from .operators import enrich as EN  # noqa: E402

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_AUDIT_ARN = ("CASE WHEN user_id % 3 = 0 THEN concat('arn:aws:iam::', lpad(CAST(user_id AS STRING), 12, '0'), "
              "':user/u', CAST(user_id AS STRING)) "
              "WHEN user_id % 3 = 1 THEN concat('arn:aws:sts::', lpad(CAST(user_id AS STRING), 12, '0'), "
              "':assumed-role/R', CAST(user_id % 7 AS STRING), '/s', CAST(event_id AS STRING)) "
              "ELSE concat('arn:aws:iam::', lpad(CAST(user_id AS STRING), 12, '0'), ':root') END")
_AUDIT_USER = "CASE WHEN user_id % 3 = 0 THEN concat('u', CAST(user_id AS STRING)) END"
_AUDIT_IP = ("concat('10.', CAST({k} % 256 AS STRING), '.', CAST(user_id % 256 AS STRING), '.', "
             "CAST(event_id % 300 AS STRING))")
_AUDIT_BUCKET = "concat('s3://bucket-', CAST({k} AS STRING))"
_AUDIT_ROLE = "concat('arn:aws:iam::', lpad(CAST({k} AS STRING), 12, '0'), ':role/Role', CAST({k} AS STRING))"
_AUDIT_INSTANCE = "concat('i-', printf('%08x', event_id))"


def audit_events_from_driver(spark, sf):
    """Audit-event rows (parsed schema) derived from the driver events."""
    ev = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kk = "k"
    req = ("parse_json(concat('{\"bucketName\": \"', " + _AUDIT_BUCKET.format(k=kk) + ", '\", \"count\": ', "
           "CAST(k AS STRING), CASE WHEN event_type = 'signup' THEN concat(', \"roleArn\": \"', "
           + _AUDIT_ROLE.format(k=kk) + ", '\"') ELSE '' END, '}'))")
    resp = ("CASE WHEN event_type = 'purchase' THEN parse_json(concat('{\"instanceId\": \"', "
            + _AUDIT_INSTANCE + ", '\"}')) END")
    return ev.selectExpr(
        "CAST(event_id AS STRING) AS eventID", "CAST(ts AS TIMESTAMP) AS eventTime",
        "event_type AS eventName", "'app.example' AS eventSource",
        f"named_struct('type', 'IAMUser', 'arn', {_AUDIT_ARN}, 'userName', {_AUDIT_USER}) AS userIdentity",
        f"{_AUDIT_IP.format(k=kk)} AS sourceIPAddress",
        f"{req} AS requestParameters", f"{resp} AS responseElements")


def _duck_audit_entities() -> str:
    k = _K
    fields = f"""
  SELECT event_id, 0 AS fno, {_AUDIT_ARN} AS text FROM events
  UNION ALL SELECT event_id, 1, {_AUDIT_USER} FROM events WHERE user_id % 3 = 0
  UNION ALL SELECT event_id, 2, {_AUDIT_IP.format(k=k)} FROM events
  UNION ALL SELECT event_id, 3, {_AUDIT_BUCKET.format(k=k)} FROM events
  UNION ALL SELECT event_id, 5, {_AUDIT_ROLE.format(k=k)} FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 6, {_AUDIT_INSTANCE} FROM events WHERE event_type = 'purchase'"""
    return f"""
fld AS ({fields}),
ex AS ({_duck_entity_sql("SELECT event_id * 10 + fno AS rid, text FROM fld")}),
fe AS (SELECT f.event_id, f.fno, f.text, ex.entity_type, ex.entity_id,
              CASE WHEN f.fno = 0 THEN least(0.95, ex.confidence + 0.1) ELSE ex.confidence END AS confidence
       FROM ex JOIN fld f ON ex.rid = f.event_id * 10 + f.fno
       WHERE (f.fno = 0 AND ex.entity_type = CASE WHEN contains(f.text, ':user/') THEN 'iam_user_arn'
                                               WHEN contains(f.text, ':role/') OR contains(f.text, ':assumed-role/')
                                               THEN 'iam_role_arn' ELSE ex.entity_type END
              AND ex.entity_type IN ('iam_role_arn', 'iam_user_arn'))
          OR (f.fno = 1 AND ex.entity_type = 'iam_user_arn')
          OR (f.fno = 2 AND ex.entity_type = 'ip_address')
          OR f.fno >= 3),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, entity_type, entity_id
                                                   ORDER BY confidence DESC, fno) AS k FROM fe) WHERE k = 1)"""


@register("entities_audit_events", f"""
WITH {_duck_audit_entities()}
SELECT CAST(event_id AS VARCHAR) AS log_id, entity_type, entity_id, round(confidence, 6) AS confidence,
       CASE fno WHEN 0 THEN 'userIdentity.arn' WHEN 1 THEN 'userIdentity.userName'
                WHEN 2 THEN 'sourceIPAddress' WHEN 3 THEN 'requestParameters.bucketName'
                WHEN 5 THEN 'requestParameters.roleArn' ELSE 'responseElements.instanceId' END AS source_field
FROM dd""")
def q_entities_audit_events(spark, sf):
    ents = OE.cloudtrail_entities(audit_events_from_driver(spark, sf))
    x = OE.explode_entities(ents.withColumnRenamed("eventID", "log_id"), "entities", keep=["log_id"])
    return x.select("log_id", "entity_type", "entity_id", r6("confidence").alias("confidence"),
                    "source_field")


@register("enrich_audit_events", f"""
WITH {_duck_audit_entities()},
sc AS (SELECT event_id, entity_type,
              CASE entity_type WHEN 'ip_address' THEN 0.4 WHEN 'vpc_id' THEN 0.2 ELSE 0.5 END AS score FROM dd),
agg AS (SELECT e.event_id, count(sc.event_id) AS n_entities, max(score) AS mx, avg(score) AS mean,
               bool_or(entity_type IN ('iam_role_arn', 'iam_user_arn')) AS has_iam,
               bool_or(entity_type = 'ip_address') AS has_ip, bool_or(score >= 0.7) AS has_high,
               bool_or(score >= 7.0) AS attention
        FROM events e LEFT JOIN sc USING (event_id) GROUP BY e.event_id)
SELECT CAST(event_id AS VARCHAR) AS log_id, n_entities, round(coalesce(mx, 0.0), 6) AS risk_score,
       CASE WHEN n_entities = 0 THEN 'low' WHEN mx >= 8 OR mean >= 6 THEN 'high'
            WHEN mx >= 6 OR mean >= 4 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN coalesce(has_high, false) OR coalesce(has_iam, false) OR coalesce(has_ip, false)
            THEN concat_ws(' | ',
                   CASE WHEN has_high THEN '{EN.REC_HIGH_RISK}' END,
                   CASE WHEN has_iam THEN '{EN.REC_IAM}' END,
                   CASE WHEN has_ip THEN '{EN.REC_IP}' END)
            ELSE '{EN.REC_NONE}' END AS recommendations,
       coalesce(attention, false) AS requires_attention
FROM agg""")
def q_enrich_audit_events(spark, sf):
    out = EN.enrich_cloudtrail(audit_events_from_driver(spark, sf))
    return out.select("log_id", F.size("entities").alias("n_entities"), r6("risk_score").alias("risk_score"),
                      "risk_level", F.concat_ws(" | ", "recommendations").alias("recommendations"),
                      "requires_attention")


# --------------------------------------------------------------------------
# labelling
# --------------------------------------------------------------------------
from .operators import labels as LB  # noqa: E402

_RE2_TOKEN = r"[\p{L}\p{N}@._:-]+|\S"


def labelled_documents(spark, sf):
    """documents → tokens, suggestions, auto BIO labels (one row per doc)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.withColumn("tokens", LB.tokenize(F.col("text")))
    d = d.withColumn("suggestions", LB.suggest_labels(F.col("text")))
    return d.withColumn("labels", LB.auto_labels(F.col("tokens"), F.col("suggestions")))


@register("labels_tokens_documents", f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, chr(31))) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(text, '{_RE2_TOKEN}') AS t FROM documents)""")
def q_labels_tokens_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", LB.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"),
                    F.md5(F.concat_ws("\u001f", "t")).alias("tokens_md5"))


@register("labels_tokens_conversations", f"""
SELECT conv_id, turn, len(t) AS n_tokens, md5(array_to_string(t, chr(31))) AS tokens_md5
FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_RE2_TOKEN}') AS t FROM conversations)""")
def q_labels_tokens_conversations(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", LB.tokenize(F.col("text")).alias("t"))
    return d.select("conv_id", "turn", F.size("t").alias("n_tokens"),
                    F.md5(F.concat_ws("\u001f", "t")).alias("tokens_md5"))


def _duck_suggestions() -> str:
    parts = []
    for ti, t in enumerate(LB.LABEL_TYPES):
        for pi, p in enumerate(LB.SUGGESTION_PATTERNS[t]):
            rp = p.replace("'", "''")
            parts.append(f"SELECT doc_id, {ti} AS ti, {pi} AS pi, '{t}' AS etype, "
                         f"regexp_extract_all(text, '{rp}') AS ms FROM documents")
    return f"""
sg0 AS ({" UNION ALL ".join(parts)}),
sg1 AS (SELECT doc_id, ti, pi, etype, unnest(ms) AS entity, unnest(range(len(ms))) AS mi FROM sg0),
sg AS (SELECT doc_id, etype, entity,
              (row_number() OVER (PARTITION BY doc_id ORDER BY ti, pi, mi) - 1)::INTEGER AS sidx FROM sg1)"""


@register("labels_suggestions_documents", f"""
WITH {_duck_suggestions()}
SELECT doc_id, sidx, entity, etype FROM sg""")
def q_labels_suggestions_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", LB.suggest_labels(F.col("text")).alias("s"))
    x = explode_rows(d, "s", "e", keep=["doc_id"], with_pos="sidx")
    return x.select("doc_id", "sidx", "e.entity", "e.etype")


def _duck_auto_labels() -> str:
    return f"""{_duck_suggestions()},
dt AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '{_RE2_TOKEN}') AS toks FROM documents),
tk AS MATERIALIZED (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS j FROM dt),
se AS (SELECT sg.*, regexp_extract_all(entity, '{_RE2_TOKEN}') AS et FROM sg),
cand AS (SELECT se.doc_id, se.sidx, se.etype, se.et, len(se.et) AS n, tk.j AS st
         FROM se JOIN tk ON tk.doc_id = se.doc_id AND tk.tok = se.et[1] WHERE len(se.et) > 0),
ck0 AS (SELECT *, unnest(range(n)) AS k FROM cand),
ck AS (SELECT c.doc_id, c.sidx, c.etype, c.n, c.st, count(t2.j) AS ok
       FROM ck0 c LEFT JOIN tk t2 ON t2.doc_id = c.doc_id AND t2.j = c.st + c.k AND t2.tok = c.et[c.k + 1]
       GROUP BY c.doc_id, c.sidx, c.etype, c.n, c.st),
fm AS (SELECT doc_id, sidx, etype, n, min(st) AS at FROM ck WHERE ok = n GROUP BY ALL),
lb AS (SELECT tk.doc_id, tk.j, tk.tok,
              coalesce(arg_max(CASE WHEN tk.j = fm.at THEN 'B-' ELSE 'I-' END || fm.etype, fm.sidx), 'O') AS label
       FROM tk LEFT JOIN fm ON fm.doc_id = tk.doc_id AND tk.j >= fm.at AND tk.j < fm.at + fm.n
       GROUP BY tk.doc_id, tk.j, tk.tok),
dl0 AS (SELECT doc_id, list(label ORDER BY j) AS labels, list(tok ORDER BY j) AS toks FROM lb GROUP BY doc_id),
dl AS (SELECT d.doc_id, coalesce(dl0.labels, []) AS labels, coalesce(dl0.toks, []) AS toks
       FROM documents d LEFT JOIN dl0 USING (doc_id))"""


@register("labels_auto_bio_documents", f"""
WITH {_duck_auto_labels()}
SELECT doc_id, len(labels) AS n_labels, len(list_filter(labels, lambda l: l <> 'O')) AS n_entity_tokens,
       md5(array_to_string(labels, ',')) AS labels_md5
FROM dl""")
def q_labels_auto_bio_documents(spark, sf):
    d = labelled_documents(spark, sf)
    return d.select("doc_id", F.size("labels").alias("n_labels"),
                    F.size(F.filter("labels", lambda lab: lab != "O")).alias("n_entity_tokens"),
                    F.md5(F.concat_ws(",", "labels")).alias("labels_md5"))


@register("labels_distribution_documents", f"""
WITH {_duck_auto_labels()},
ex AS (SELECT unnest(labels) AS label FROM dl)
SELECT label, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM ex), 6) AS pct
FROM ex GROUP BY ALL""")
def q_labels_distribution_documents(spark, sf):
    dist = LB.label_distribution(labelled_documents(spark, sf))
    return dist.select("label", "count", r6("pct").alias("pct"))


@register("labels_quality_documents", f"""
WITH {_duck_auto_labels()},
lx AS (SELECT doc_id, unnest(labels) AS l, unnest(range(len(labels))) AS j FROM dl),
pv AS (SELECT doc_id, j, l, coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY j), 'O') AS p FROM lx),
bad AS (SELECT doc_id, count(*) FILTER (WHERE l LIKE 'I-%' AND p <> 'B-' || l[3:] AND NOT starts_with(p, 'I-' || l[3:])) AS bad_i,
               count(*) FILTER (WHERE l NOT IN ({", ".join("'" + t + "'" for t in LB.BIO_TAGS)})) AS unknown
        FROM pv GROUP BY ALL),
runs AS (SELECT doc_id, j, l, sum(CASE WHEN NOT starts_with(l, 'I-') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY j) AS grp FROM lx),
rl AS (SELECT doc_id, j, l, grp, first_value(l) OVER (PARTITION BY doc_id, grp ORDER BY j) AS head,
              row_number() OVER (PARTITION BY doc_id, grp ORDER BY j) AS pos FROM runs),
lw AS (SELECT doc_id, count(*) FILTER (WHERE starts_with(head, 'B-') AND starts_with(l, 'I-') AND pos > 10) AS long_w
       FROM rl GROUP BY ALL),
per AS (SELECT dl.doc_id, coalesce(bad_i, 0) + coalesce(unknown, 0) AS issues,
               coalesce(long_w, 0) + CASE WHEN len(list_filter(labels, lambda l: l <> 'O')) = 0 THEN 1 ELSE 0 END
                 AS warnings
        FROM dl LEFT JOIN bad USING (doc_id) LEFT JOIN lw USING (doc_id))
SELECT count(*) AS total_examples, sum(issues) AS issues, sum(warnings) AS warnings,
       greatest(0, 100 - sum(issues) * 10 - sum(warnings) * 2) AS quality_score FROM per""")
def q_labels_quality_documents(spark, sf):
    q = LB.quality_report(labelled_documents(spark, sf))
    return q.select("total_examples", "issues", "warnings", "quality_score")


@register("labels_spans_documents", f"""
WITH {_duck_auto_labels()},
lx AS (SELECT doc_id, unnest(labels) AS l, unnest(toks) AS t, unnest(range(len(labels))) AS j FROM dl),
g AS (SELECT *, sum(CASE WHEN starts_with(l, 'B-') OR NOT starts_with(l, 'I-') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY j) AS grp FROM lx),
h AS (SELECT *, first_value(l) OVER (PARTITION BY doc_id, grp ORDER BY j) AS head FROM g)
SELECT doc_id, head[3:] AS etype, string_agg(t, ' ' ORDER BY j) AS text
FROM h WHERE starts_with(head, 'B-') GROUP BY doc_id, grp, head""")
def q_labels_spans_documents(spark, sf):
    d = labelled_documents(spark, sf)
    x = explode_rows(d, LB.bio_spans(F.col("tokens"), F.col("labels")), "s", keep=["doc_id"])
    return x.select("doc_id", "s.etype", "s.text")


# quality label predicted by a length rule, compared with the labels table
@register("labels_metrics_quality", """
WITH p AS (SELECT CAST(l.quality AS VARCHAR) AS y,
                  CASE WHEN d.n_chars >= 2000 THEN '1' ELSE '0' END AS yhat
           FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT y, yhat, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT y AS cls FROM c UNION SELECT yhat FROM c),
per AS (SELECT cls,
               coalesce((SELECT sum(n) FROM c WHERE y = cls), 0) AS support,
               coalesce((SELECT sum(n) FROM c WHERE yhat = cls), 0) AS predicted,
               coalesce((SELECT sum(n) FROM c WHERE y = cls AND yhat = cls), 0) AS tp FROM cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)
SELECT round(sum(pr * support) / sum(support), 6) AS precision, round(sum(rc * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1, round(sum(tp) / sum(support), 6) AS accuracy FROM f""")
def q_labels_metrics_quality(spark, sf):
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    pairs = lab.join(doc, "doc_id").select(
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("n_chars") >= 2000, "1").otherwise("0").alias("predicted"))
    m = LB.token_metrics(pairs)
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@register("labels_split_documents", """
SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 15))::BIGINT % 100 AS h FROM documents)""")
def q_labels_split_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", LB.split_assign(F.col("doc_id"), seed=42).alias("split"))


# --------------------------------------------------------------------------
# governance (J9, J10, J12, J16, A17, A18, A24, PF16) on objects derived
# from orders: bucket from priority, object age from the order date
# --------------------------------------------------------------------------
from .operators import govern as GV  # noqa: E402

AS_OF_DATE = "1999-01-01"
_BUCKET_SQL = ("concat('sec-', CASE o_orderpriority WHEN '1-URGENT' THEN 'logs' WHEN '2-HIGH' THEN 'compliance' "
               "WHEN '3-MEDIUM' THEN 'models' ELSE 'misc' END, '-', lower(o_orderstatus))")
_AGE_SQL = f"datediff(DATE '{AS_OF_DATE}', CAST(o_orderdate AS DATE))"


def object_inventory(spark, sf):
    o = table(spark, sf, "orders")
    inv = o.selectExpr(f"{_BUCKET_SQL} AS bucket", "concat('obj/', CAST(o_orderkey AS STRING)) AS key",
                       "CAST(floor(o_totalprice * 1000) AS BIGINT) AS size", "o_orderdate AS last_modified",
                       f"{_AGE_SQL} AS age_days")
    inv = inv.withColumn("tier", GV.bucket_tier(F.col("bucket")))
    pol = GV.policy_table(spark)
    x = GV._attach_policy(inv, pol)
    return x.withColumn("storage_class", GV.storage_class_for_age(F.col("age_days"),
                                                                  F.col("lifecycle_transitions")))


def _duck_tier(col):
    return (f"CASE WHEN contains({col}, 'logs') THEN 'raw_security_logs' WHEN contains({col}, 'compliance') "
            f"THEN 'compliance_outputs' WHEN contains({col}, 'models') THEN 'model_artifacts' "
            f"ELSE 'raw_security_logs' END")


_DUCK_INV = f"""
inv AS (SELECT {_BUCKET_SQL.replace("lower(", "lower(")} AS bucket, o_orderkey,
               CAST(floor(o_totalprice * 1000) AS BIGINT) AS size,
               date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF_DATE}') AS age_days FROM orders),
it AS (SELECT *, {_duck_tier("bucket")} AS tier FROM inv),
ic AS (SELECT *, CASE tier
          WHEN 'raw_security_logs' THEN CASE WHEN age_days >= 1095 THEN 'DEEP_ARCHIVE' WHEN age_days >= 365 THEN 'GLACIER'
                                             WHEN age_days >= 30 THEN 'STANDARD_IA' ELSE 'STANDARD' END
          WHEN 'compliance_outputs' THEN CASE WHEN age_days >= 730 THEN 'GLACIER' WHEN age_days >= 90 THEN 'STANDARD_IA'
                                              ELSE 'STANDARD' END
          WHEN 'model_artifacts' THEN CASE WHEN age_days >= 90 THEN 'GLACIER' WHEN age_days >= 30 THEN 'STANDARD_IA'
                                           ELSE 'STANDARD' END
          ELSE 'STANDARD' END AS storage_class FROM it)"""


@register("govern_storage_classes_orders", f"""
WITH {_DUCK_INV}
SELECT bucket, tier, storage_class, count(*) AS n_objects, sum(size) AS total_bytes FROM ic GROUP BY ALL""")
def q_govern_storage_classes_orders(spark, sf):
    inv = object_inventory(spark, sf)
    return inv.groupBy("bucket", "tier", "storage_class").agg(
        F.count(F.lit(1)).alias("n_objects"), F.sum("size").alias("total_bytes"))


@register("govern_storage_metrics_orders", f"""
WITH {_DUCK_INV}
SELECT bucket, count(*) AS total_objects, sum(size) AS total_size_bytes,
       round(sum(size) / 1073741824.0 * 0.023, 6) AS cost_estimate_monthly FROM ic GROUP BY ALL""")
def q_govern_storage_metrics_orders(spark, sf):
    m = GV.storage_metrics(object_inventory(spark, sf))
    return m.select("bucket", "total_objects", "total_size_bytes",
                    r6("cost_estimate_monthly").alias("cost_estimate_monthly"))


def bucket_configs(spark, sf):
    """Declared configuration per bucket, derived from its inventory."""
    inv = object_inventory(spark, sf)
    agg = inv.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("age_days").alias("max_age"),
                                    F.count_distinct("storage_class").alias("n_classes"))
    return agg.select(
        "bucket",
        F.when(F.col("n") % 7 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("max_age") % 3000).cast("int")).alias("expiration_days"),
        F.when(F.col("n") % 7 == 0, F.array().cast(GV.TRANSITIONS_T)).otherwise(F.slice(F.array(
            F.struct(F.lit(30).alias("days"), F.lit("STANDARD_IA").alias("storage_class")),
            F.struct(F.lit(365).alias("days"), F.lit("GLACIER").alias("storage_class")),
            F.struct(F.lit(1095).alias("days"), F.lit("DEEP_ARCHIVE").alias("storage_class"))),
            1, F.col("n_classes").cast("int"))).alias("transitions"),
        (F.col("n") % 2 == 0).alias("lock_enabled"), (F.col("n") % 9).cast("int").alias("lock_years"),
        F.when(F.col("n") % 3 == 0, F.lit(None)).when(F.col("n") % 3 == 1, F.lit("aws:kms"))
         .otherwise(F.lit("AES256")).alias("sse_algorithm"))


_DUCK_CFG = f"""{_DUCK_INV},
cfg0 AS (SELECT bucket, count(*) AS n, max(age_days) AS max_age, count(DISTINCT storage_class) AS n_classes
         FROM ic GROUP BY ALL),
cfg AS (SELECT bucket, {_duck_tier("bucket")} AS tier,
               CASE WHEN n % 7 = 0 THEN NULL ELSE max_age % 3000 END AS expiration_days,
               CASE WHEN n % 7 = 0 THEN 0 ELSE least(n_classes, 3) END AS n_trans,
               n % 2 = 0 AS lock_enabled, n % 9 AS lock_years,
               CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 'aws:kms' ELSE 'AES256' END AS sse_algorithm
        FROM cfg0),
pol AS (SELECT * FROM (VALUES ('raw_security_logs', 7, true, 3), ('compliance_outputs', 5, true, 2),
                              ('model_artifacts', 3, false, 2)) t(ptier, years, immutable, n_expected)),
v AS (SELECT c.*, coalesce(years, 7) AS years, coalesce(immutable, false) AS immutable,
             coalesce(n_expected, 0) AS n_expected FROM cfg c LEFT JOIN pol ON ptier = tier),
vi AS (SELECT bucket, tier, list_filter([
          CASE WHEN expiration_days IS NULL AND n_trans = 0 THEN 'No lifecycle rules configured' END,
          CASE WHEN NOT (expiration_days IS NULL AND n_trans = 0) AND expiration_days < years * 365
               THEN printf('Retention period %d days is less than required %d days', expiration_days, years * 365) END,
          CASE WHEN NOT (expiration_days IS NULL AND n_trans = 0) AND n_expected > 0 AND n_trans < n_expected
               THEN 'Missing expected lifecycle transitions' END], lambda x: x IS NOT NULL) AS life,
        CASE WHEN immutable THEN list_filter([
          CASE WHEN NOT coalesce(lock_enabled, false) THEN 'Object Lock not enabled' END,
          CASE WHEN lock_years < years THEN printf('Object Lock retention %d years is less than required %d years',
                                                   lock_years, years) END], lambda x: x IS NOT NULL)
             ELSE [] END AS lck,
        list_filter([CASE WHEN sse_algorithm IS NULL THEN 'No encryption configuration found'
                          WHEN sse_algorithm <> 'aws:kms' THEN 'KMS encryption not configured' END],
                    lambda x: x IS NOT NULL) AS enc
       FROM v)"""


@register("govern_bucket_validation_orders", f"""
WITH {_DUCK_CFG}
SELECT bucket, tier, len(life) = 0 AS lifecycle_compliant, len(lck) = 0 AS object_lock_compliant,
       len(enc) = 0 AS encryption_compliant, array_to_string(list_concat(life, lck, enc), ' | ') AS issues,
       len(list_concat(life, lck, enc)) = 0 AS compliant FROM vi""")
def q_govern_bucket_validation_orders(spark, sf):
    v = GV.validate_buckets(bucket_configs(spark, sf), GV.policy_table(spark))
    return v.select("bucket", "tier", "lifecycle_compliant", "object_lock_compliant", "encryption_compliant",
                    F.concat_ws(" | ", "issues").alias("issues"), "compliant")


@register("govern_compliance_report_orders", f"""
WITH {_DUCK_CFG},
m AS (SELECT bucket, sum(size) AS b FROM ic GROUP BY ALL),
r AS (SELECT vi.bucket, list_concat(life, lck, enc) AS issues, len(list_concat(life, lck, enc)) = 0 AS compliant,
             coalesce(m.b, 0) AS b FROM vi LEFT JOIN m USING (bucket)),
ci AS (SELECT count(*) AS n FROM (SELECT unnest(issues) AS i FROM r WHERE NOT compliant)
       WHERE lower(i) SIMILAR TO '.*(encryption|retention|object lock).*')
SELECT count(*) AS total_buckets, count_if(compliant) AS compliant_buckets,
       round(count_if(compliant) / count(*), 6) AS compliance_rate,
       round(sum(b) / 1073741824.0 * 0.023, 6) AS total_cost_monthly,
       round(sum(b / 1099511627776.0), 6) AS total_size_tb,
       (SELECT n FROM ci) AS n_critical_issues,
       array_to_string(list_filter([CASE WHEN count_if(compliant) < count(*) THEN '{GV.REC_REVIEW}' END,
                                    CASE WHEN sum(b) / 1073741824.0 * 0.023 > 1000 THEN '{GV.REC_COST}' END],
                                   lambda x: x IS NOT NULL), ' | ') AS recommendations
FROM r""")
def q_govern_compliance_report_orders(spark, sf):
    v = GV.validate_buckets(bucket_configs(spark, sf), GV.policy_table(spark))
    m = GV.storage_metrics(object_inventory(spark, sf))
    rep = GV.compliance_report(v, m)
    return rep.select("total_buckets", "compliant_buckets", r6("compliance_rate").alias("compliance_rate"),
                      r6("total_cost_monthly").alias("total_cost_monthly"),
                      r6("total_size_tb").alias("total_size_tb"),
                      "n_critical_issues",
                      F.concat_ws(" | ", "recommendations").alias("recommendations"))


@register("govern_critical_issues_orders", f"""
WITH {_DUCK_CFG},
r AS (SELECT bucket, unnest(list_concat(life, lck, enc)) AS issue FROM vi)
SELECT bucket, issue FROM r WHERE lower(issue) SIMILAR TO '.*(encryption|retention|object lock).*'""")
def q_govern_critical_issues_orders(spark, sf):
    return GV.critical_issues(GV.validate_buckets(bucket_configs(spark, sf), GV.policy_table(spark)))


def audit_from_orders(spark, sf, *more):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("rec-"), F.col("o_orderkey").cast("string")).alias("recommendation_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("boolean"))
         .otherwise(F.col("o_orderkey") % 2 == 0).alias("applied"),
        F.when(F.col("o_orderstatus") == "O", "RECOMMENDED").when(F.col("o_orderstatus") == "F", "RECONCILED")
         .otherwise("DISMISSED").alias("status"),
        F.lit(None).cast("timestamp").alias("reconciled_at"), *more)


_DUCK_AUDIT = """
au AS (SELECT 'rec-' || CAST(o_orderkey AS VARCHAR) AS recommendation_id,
              CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS applied,
              CASE o_orderstatus WHEN 'O' THEN 'RECOMMENDED' WHEN 'F' THEN 'RECONCILED' ELSE 'DISMISSED' END AS status
       FROM orders)"""


@register("govern_reconcile_summary_orders", f"""
WITH {_DUCK_AUDIT}
SELECT count_if(status = 'RECOMMENDED') AS scanned,
       count_if(status = 'RECOMMENDED' AND coalesce(applied, false)) AS reconciled,
       count_if(status = 'RECOMMENDED') - count_if(status = 'RECOMMENDED' AND coalesce(applied, false)) AS missing
FROM au""")
def q_govern_reconcile_summary_orders(spark, sf):
    _, summary = GV.reconcile(audit_from_orders(spark, sf))
    return summary


@register("govern_reconciled_table_orders", f"""
WITH {_DUCK_AUDIT}
SELECT CASE WHEN status = 'RECOMMENDED' AND coalesce(applied, false) THEN 'RECONCILED' ELSE status END AS status,
       count(*) AS n, count_if(status = 'RECOMMENDED' AND coalesce(applied, false)) AS n_stamped
FROM au GROUP BY 1""")
def q_govern_reconciled_table_orders(spark, sf):
    updated, _ = GV.reconcile(audit_from_orders(spark, sf), F.lit("2025-10-09 00:00:00").cast("timestamp"))
    return updated.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                         F.count("reconciled_at").alias("n_stamped"))


@register("govern_open_recommendations_orders", f"""
WITH {_DUCK_AUDIT}
SELECT recommendation_id, coalesce(applied, false) AS applied_flag FROM au WHERE status = 'RECOMMENDED'""")
def q_govern_open_recommendations_orders(spark, sf):
    au = audit_from_orders(spark, sf)
    op = GV.open_recommendations(au)
    return op.select("recommendation_id", GV.action_applied(op).alias("applied_flag"))


# --------------------------------------------------------------------------
# streaming (ST2, ST3, ST5) — the stream runs over the driver events table
# with an availableNow trigger; ST5 also as its batch formulation
# --------------------------------------------------------------------------
from .streaming import detectors as SD  # noqa: E402
from .streaming.runner import run_available_now, run_updates_now, stream_files, time_ordered_files  # noqa: E402

_EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_files(spark, sf):
    """The events as three consecutive time ranges: three micro-batches."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return time_ordered_files(ev, "ts", "events")


def _events_stream(spark, sf):
    root, files = _event_files(spark, sf)
    s = stream_files(spark, root, _EVENTS_SCHEMA, max_files_per_trigger=files)
    k = F.get_json_object("props", "$.k")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("action"), k.alias("source"),
                    F.col("user_id").cast("string").alias("user_key"))


@register("stream_error_alarm_events", """
SELECT time_bucket(INTERVAL 1 minute, ts) AS period_start,
       time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute AS period_end,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS value,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 1 AS alarm
FROM events GROUP BY ALL""")
def q_stream_error_alarm_events(spark, sf):
    root, files = _event_files(spark, sf)
    ev = stream_files(spark, root, _EVENTS_SCHEMA, max_files_per_trigger=files)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    out = SD.tumbling_alarm(ev, "ts", F.when(F.col("event_type") == "error", 1).otherwise(0), "1 minute",
                            watermark="1 day")
    out = run_updates_now(out, "error_alarm", ["period_start"])
    return out.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"),
                      F.col("period_end").cast("timestamp_ntz").alias("period_end"),
                      F.col("value").cast("bigint").alias("value"), "alarm")


@register("stream_profile_prior_events", _duck_behavior("prior"))
def q_stream_profile_prior_events(spark, sf):
    s = _events_stream(spark, sf).select("event_id", "ts", F.lit("user").alias("entity_type"),
                                         F.col("user_key").alias("entity_id"), "action", "source")
    out = run_available_now(SD.profile_detector_stream(s, mode="prior"), "profile_prior")
    return out.select("event_id", "entity_id", "anomaly_type", r6("score").alias("score"), "confidence",
                      F.concat_ws(" | ", "factors").alias("factors"))


@register("stream_escalation_events_24h", _duck_escalation(1440))
def q_stream_escalation_events_24h(spark, sf):
    out = run_available_now(SD.escalation_stream(_events_stream(spark, sf), patterns=EVENT_PATTERNS,
                                                 lookback_minutes=1440), "escalation_24h")
    return out.select("event_id", "entity_id", F.col("pattern").alias("pname"), "score",
                      F.col("factors")[1].alias("recent"))


@register("stream_reconcile_alarm_orders", """
SELECT time_bucket(INTERVAL 60 minute, o_orderdate) AS period_start,
       sum(CASE WHEN o_orderstatus = 'O' AND NOT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL
                                                             ELSE o_orderkey % 2 = 0 END, false)
                THEN 1 ELSE 0 END) AS value,
       sum(CASE WHEN o_orderstatus = 'O' AND NOT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL
                                                             ELSE o_orderkey % 2 = 0 END, false)
                THEN 1 ELSE 0 END) >= 1 AS alarm
FROM orders GROUP BY ALL""")
def q_stream_reconcile_alarm_orders(spark, sf):
    """ST6: missing reconciliations (open and not applied) per 60 minutes."""
    au = audit_from_orders(spark, sf, F.col("o_orderdate").cast("timestamp").alias("ts"))
    root, files = time_ordered_files(au, "ts", "recommendations")
    x = stream_files(spark, root, au.schema.simpleString()[7:-1].replace(":", " "), max_files_per_trigger=files)
    missing = ((F.col("status") == "RECOMMENDED") & ~GV.action_applied(x)).cast("int")
    out = run_updates_now(SD.tumbling_alarm(x, "ts", missing, "60 minutes", watermark="1 day"), "reconcile_alarm",
                          ["period_start"])
    return out.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"),
                      F.col("value").cast("bigint").alias("value"), "alarm")


# --------------------------------------------------------------------------
# end to end: derived audit events → F6 entities → user key (PF11) → all
# detectors → weights → A8
# --------------------------------------------------------------------------
def _duck_audit_engine(threshold: float = 2.5, lookback_minutes: int = 30) -> str:
    hi = ",".join("'" + a + "'" for a in B.HIGH_RISK_ACTIONS)
    md = ",".join("'" + a + "'" for a in B.MEDIUM_RISK_ACTIONS)
    pats = " UNION ALL ".join(f"SELECT {list(acts)!r} AS pacts, {b} AS base" for acts, b in B.ESCALATION_PATTERNS.values())
    weight = " ".join(f"WHEN '{t}' THEN {w}" for t, w in B.DETECTOR_WEIGHTS.items())
    seen = ("count(*) OVER (PARTITION BY entity_type, entity_id{} ORDER BY ts, id "
            "ROWS UNBOUNDED PRECEDING)").format
    return f"""
WITH {_duck_audit_entities()},
ev AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, ts, event_type AS action, {_AUDIT_IP.format(k=_K)} AS source,
              coalesce(nullif({_AUDIT_ARN}, ''), nullif({_AUDIT_USER}, '')) AS user_key FROM events),
ee AS (SELECT ev.*, hour(ts) AS hr, entity_type, entity_id FROM dd JOIN ev USING (event_id)),
c AS (SELECT *, {seen("")} - 1 AS n, {seen(", hr")} - 1 AS hc, {seen(", action")} AS a_incl,
             {seen(", source")} AS s_incl FROM ee),
en AS (SELECT event_id, id, ts, entity_type AS t, row_number() OVER (PARTITION BY event_id ORDER BY entity_type, entity_id) AS pos,
              count(*) OVER (PARTITION BY event_id) AS k FROM ee),
tot AS (SELECT event_id, row_number() OVER (ORDER BY ts, id) AS total
        FROM (SELECT DISTINCT event_id, id, ts FROM en WHERE k >= 2)),
pr AS (SELECT a.event_id, a.id, a.ts, least(a.t, b.t) AS t1, greatest(a.t, b.t) AS t2, count(*) AS m
       FROM en AS a JOIN en AS b ON a.event_id = b.event_id AND a.pos < b.pos GROUP BY ALL),
pc AS (SELECT event_id, m, total, sum(m) OVER (PARTITION BY t1, t2 ORDER BY ts, id ROWS UNBOUNDED PRECEDING) * 1.0 / total AS f
       FROM pr JOIN tot USING (event_id)),
w AS (SELECT a.event_id, list(b.action) AS acts
      FROM ev AS a JOIN ev AS b ON a.user_key = b.user_key AND b.ts > a.ts - INTERVAL {lookback_minutes} MINUTE
           AND (b.ts < a.ts OR b.ts = a.ts AND b.id <= a.id)
      GROUP BY ALL),
allr AS (
  SELECT event_id, 'time_pattern_anomaly' AS kind, least(8.0 - 100.0 * hc / n, 10.0) AS score
  FROM c WHERE n >= 10 AND hc * 1.0 / n < 0.05 AND hc < 2
  UNION ALL SELECT event_id, 'behavioral_deviation',
    CASE WHEN action IN ({hi}) THEN 9.0 WHEN action IN ({md}) THEN 6.0 ELSE 4.0 END FROM c WHERE n >= 10 AND a_incl = 1
  UNION ALL SELECT event_id, 'behavioral_deviation', 6.0 FROM c WHERE n >= 10 AND source <> '' AND s_incl = 1
  UNION ALL SELECT event_id, 'rare_entity_combination', least(10.0 * (1 - f / 0.01), 10.0)
  FROM pc, range(m) WHERE total >= 100 AND f < 0.01
  UNION ALL SELECT event_id, 'privilege_escalation', least(base + CASE WHEN len(acts) >= 3 THEN 1.0 ELSE 0.0 END, 10.0)
  FROM w, ({pats}) AS p WHERE list_has_all(acts, pacts)),
wt AS (SELECT event_id, CAST(score * CASE kind {weight} ELSE 1.0 END AS DOUBLE) AS x FROM allr),
per AS (SELECT event_id, least(max(x), 10.0) AS top, count(*) FILTER (x >= {threshold}) AS hits, count(*) AS n FROM wt GROUP BY ALL)
SELECT ev.id AS event_id, round(least(coalesce(top, 0.0) * CASE WHEN hits > 1 THEN 1 + 0.2 * (hits - 1) ELSE 1 END, 10.0), 6)
         AS aggregate_score, coalesce(hits, 0) AS n_anomalies, coalesce(per.n, 0) AS n_scores
FROM ev LEFT JOIN per ON per.event_id = ev.event_id"""


@register("engine_audit_events_end_to_end", _duck_audit_engine())
def q_engine_audit_events_end_to_end(spark, sf):
    ev = OE.cloudtrail_entities(audit_events_from_driver(spark, sf).withColumn("awsRegion", F.lit("us-east-1")))
    # the extraction feeds four detector branches: materialise it once in the
    # shared checkpoint folder instead of recomputing it per branch
    det = cut_lineage(B.audit_detector_input(ev))
    sc = B.score_events(det, mode="prior", threshold=2.5)
    agg = B.aggregate_scores(det.select("event_id", "ts"), sc)
    return agg.select("event_id", r6("aggregate_score").alias("aggregate_score"), "n_anomalies", "n_scores")


# --------------------------------------------------------------------------
# Oracle output types: DuckDB returns DECIMAL for decimal literals and
# HUGEINT for integer sums / count_if; Spark returns DOUBLE / BIGINT.  The
# oracle results are cast to the Spark types (values unchanged).
# --------------------------------------------------------------------------
_ORACLE_CASTS = {
    "behavior_parity_events": {"confidence": "DOUBLE"},
    "behavior_prior_events": {"confidence": "DOUBLE"},
    "stream_profile_prior_events": {"confidence": "DOUBLE"},
    "behavior_escalation_events_24h": {"score": "DOUBLE"},
    "behavior_escalation_events_30m": {"score": "DOUBLE"},
    "stream_escalation_events_24h": {"score": "DOUBLE"},
    "enrich_audit_events": {"risk_score": "DOUBLE"},
    "engine_aggregate_events": {"n_anomalies": "BIGINT"},
    "analysis_metrics_events": {"detected_anomalies": "BIGINT", "scores_above_threshold": "BIGINT"},
    "analysis_threshold_sweep_events": {"anomaly_count": "BIGINT"},
    "analysis_threshold_recommendation_events": {"current_count": "BIGINT"},
    "analysis_running_rate_events": {"total_profiles": "BIGINT"},
    "labels_quality_documents": {"issues": "BIGINT", "warnings": "BIGINT", "quality_score": "BIGINT"},
    "govern_storage_classes_orders": {"total_bytes": "BIGINT"},
    "govern_storage_metrics_orders": {"total_size_bytes": "BIGINT"},
    "govern_compliance_report_orders": {"compliant_buckets": "BIGINT"},
    "govern_reconcile_summary_orders": {"scanned": "BIGINT", "reconciled": "BIGINT", "missing": "BIGINT"},
    "govern_reconciled_table_orders": {"n_stamped": "BIGINT"},
    "stream_error_alarm_events": {"value": "BIGINT"},
    "stream_reconcile_alarm_orders": {"value": "BIGINT"},
}
for _name, _casts in _ORACLE_CASTS.items():
    _rep = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _casts.items())
    ORACLE[_name] = f"SELECT * REPLACE ({_rep}) FROM (\n{ORACLE[_name]}\n) AS _o"
