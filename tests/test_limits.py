"""Inputs at the edges: infinities, long files, every payload kind, hot days,
missing snapshots, long texts."""
import json
import time

from pyspark.sql import functions as F

from logsleuth.functions import entities as FE
from logsleuth.operators import behavior as B
from logsleuth.operators import enrich as EN
from logsleuth.operators import labels as LB
from logsleuth.plans.quantiles import exact_quantiles, value_bucket
from logsleuth.plans.ranking import balanced_segments, running_count
from logsleuth.sources import cloudtrail as CT
from logsleuth.streaming import detectors as SD

INF, MAX = float("inf"), 1.7976931348623157e308


def test_quantiles_of_extreme_values(spark):
    groups = {"inf": [1.0, 2.0, 3.0, INF], "neg": [-INF, -5.0, 7.0], "big": [1e308, 1.79e308, MAX],
              "tiny": [5e-324, 1e-323, 2e-310], "zero": [0.0, -0.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"inf": 2.5, "neg": -5.0, "big": 1.79e308, "tiny": 1e-323, "zero": 0.0}
    whole = exact_quantiles(df.where("k = 'inf'"), [], "v", {"m": 0.5})
    assert whole.first().m == 2.5 and "CartesianProduct" not in whole._jdf.queryExecution().toString()


def test_buckets_follow_the_order(spark):
    vals = sorted({s * m * 2.0 ** e for s in (-1, 1) for m in (1.0, 1.0000001, 1.5, 1.9999999)
                   for e in (-1074, -1050, -1022, -900, -899, -1, 0, 1, 52, 899, 900, 901, 1023)} | {0.0, -INF, INF, MAX, -MAX})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r.b for r in df.select("i", value_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def _event(i):
    return {"eventVersion": "1", "eventSource": "s", "eventName": "n", "awsRegion": "r", "requestID": "q", "eventID": str(i),
            "eventType": "t", "recipientAccountId": "1", "eventTime": "2024-01-01T00:00:00Z", "userIdentity": {"type": "IAMUser"}}


def test_json_lines_of_any_length(spark):
    text = "\n".join([json.dumps(_event(i)) for i in range(2300)] + ["broken {"])
    out = CT.parse_cloudtrail_text(spark.createDataFrame([(text,)], "value string"), lines=True)
    assert out.where("size(errors) = 0").select("line_index").distinct().count() == 2300
    bad = out.where("record_index IS NULL").collect()
    assert len(bad) == 1 and bad[0].line_index == 2300


def test_no_payload_is_lost(spark):
    ok, half = json.dumps(_event(1)), json.dumps({"eventSource": "s"})
    body = lambda *b: json.dumps({"Records": [{"body": x} for x in b]})
    msgs = ["not json", '{"invalid": 1}', json.dumps({"log_data": _event(2)}), json.dumps({"log_data": {"a": 1}}), "[1]", "7",
            body(ok, "oops", "{}", half), '{"Records": 5}', None]
    routed = CT.route_messages(spark.createDataFrame(list(enumerate(msgs)), "n int, value string"))
    got = sorted((r.n, r.record_index, r.status) for r in routed.collect())
    assert got == [(0, 0, "rejected"), (1, 0, "invalid"), (2, 0, "valid"), (3, 0, "invalid"), (4, 0, "rejected"),
                   (5, 0, "rejected"), (6, 0, "valid"), (6, 1, "rejected"), (6, 2, "skipped"), (6, 3, "rejected"),
                   (7, 0, "rejected"), (8, 0, "rejected")]
    s = EN.results_summary(routed).first()
    assert (s.total_events, s.successful_results, s.errors) == (11, 2, 9)
    assert EN.error_records(routed).count() == 9
    assert SD.message_errors(spark.createDataFrame([(m,) for m in msgs], "value string")).count() == 10


def test_state_continues_from_latest_snapshot(spark, tmp_path):
    import pytest
    ev = spark.createDataFrame([(1, [("a", "1"), ("b", "2")], "x")],
                               "event_id long, entities array<struct<entity_type:string,entity_id:string>>, action string")
    root = str(tmp_path / "state")
    total = lambda df: df.where("family = 'total'").first()["count"]
    assert total(SD.combination_batch_update(ev, 0, root)) == 1
    assert total(SD.combination_batch_update(ev, 2, root)) == 2  # batch 1 wrote nothing
    assert total(SD.combination_batch_update(ev, 2, root)) == 2  # a repeated batch
    for f in (tmp_path / "state" / "delta" / "batch=2").glob("*.parquet"):
        f.write_bytes(b"damaged")
    with pytest.raises(Exception):
        total(SD.combination_batch_update(ev, 3, root))


def test_baseline_from_the_same_history(spark):
    rows = [(i, f"2024-01-01 10:{i:02d}:00", "user", "u", "Get", "1.1.1.1", "r", 0) for i in range(12)]
    new = [(99, "2024-01-02 03:00:00", "user", "u", "CreateRole", "9.9.9.9", "r", 0)]
    schema = "event_id long, ts string, entity_type string, entity_id string, action string, source string, region string, ent_ord int"
    make = lambda x: spark.createDataFrame(x, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    old = make(rows)
    out = B.detect_against_baseline(make(new), B.entity_profiles(old), B.entity_sources(old)).collect()
    assert sorted((r.anomaly_type, r.score) for r in out) == [("behavioral_deviation", 6.0), ("behavioral_deviation", 9.0),
                                                              ("time_pattern_anomaly", 8.0)]


def test_hot_day_is_split(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("u").alias("k"),
                               (F.lit(1_700_000_000) + F.col("id") % 3000).cast("timestamp").alias("ts"))
    seg = balanced_segments(df, "ts", rows=1000)
    sizes = [r["count"] for r in seg.groupBy("_bal").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 1100
    got = running_count(seg, ["k"], ["ts", "event_id"], F.col("_bal"), "n").agg(
        F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("d")).first()
    assert (got.a, got.b, got.d) == (1, n, n)


def test_escalation_across_segments(spark):
    ev = [(i, 60 * i, "u", a) for i, a in enumerate(["CreateRole", "x", "AttachRolePolicy", "y", "z", "AssumeRole", "w"])]
    df = spark.createDataFrame(ev, "event_id long, t long, user_key string, action string") \
              .withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    rows = lambda n: sorted((r.event_id, r.entity_id, r.score, tuple(r.factors)) for r in
                            B.privilege_escalation(df, segment_rows=n).collect())
    assert rows(1) == rows(2) == rows(1_000_000) and len(rows(1)) == 2


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(20_000))
    df = spark.createDataFrame([(text,)], "text string")
    t0 = time.time()
    out = FE.add_text_entities(df, "text", entity_types=["ip_address"])
    assert out.select(F.size(FE.dedupe_entities(F.col("entities"))).alias("n")).first().n == 20_000
    assert time.time() - t0 < 60


def test_split_is_a_hash(spark):
    df = spark.range(0, 100_000, 100).select(LB.split_assign(F.col("id"), seed=1).alias("a"),
                                             LB.split_assign(F.col("id"), seed=2).alias("b"))
    shares = {r.a: r["count"] for r in df.groupBy("a").count().collect()}
    assert 700 < shares["train"] < 880 and shares["test"] > 50
    assert df.where("a <> b").count() > 100
    empty = LB.quality_report(spark.createDataFrame([], "tokens array<string>, labels array<string>")).first()
    assert (empty.issues, empty.warnings, empty.quality_score) == (0, 0, 100)


def test_fixed_values_are_pinned():
    assert set(B.HIGH_RISK_ACTIONS) >= {"CreateRole", "AttachUserPolicy", "AssumeRole"} and len(B.HIGH_RISK_ACTIONS) == 11
    assert B.ESCALATION_PATTERNS["admin_access"] == (["AttachUserPolicy", "AttachRolePolicy"], 9.5)
    assert B.DETECTOR_WEIGHTS["privilege_escalation"] == 0.4 and B.DETECTOR_WEIGHTS["lateral_movement"] == 0.35
    assert len(LB.BIO_TAGS) == len(set(LB.BIO_TAGS)) and "O" in LB.BIO_TAGS
    assert EN.REC_NONE == "No immediate compliance actions required"
