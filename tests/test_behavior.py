from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsleuth.operators import behavior as B

T0 = datetime(2024, 1, 15, 9, 0, 0)
EE_SCHEMA = ("event_id long, ts timestamp, entity_type string, entity_id string, action string, "
             "source string, region string, ent_ord int")


def _ee(spark, rows):
    return spark.createDataFrame(rows, EE_SCHEMA)


def _hour9(n, action="GetObject", source="10.0.0.1"):
    return [(i, T0 + timedelta(minutes=i), "iam_user_arn", "u", action, source, "us-east-1", 0)
            for i in range(n)]


def test_time_anomaly_parity(spark):
    rows = _hour9(20) + [(20, datetime(2024, 1, 16, 3, 0), "iam_user_arn", "u", "GetObject", "10.0.0.1",
                          "us-east-1", 0)]
    out = B.behavioral_anomalies(_ee(spark, rows), mode="parity").collect()
    assert len(out) == 1 and out[0].event_id == 20
    assert out[0].score == pytest.approx(8 - 100 / 21, abs=1e-6)
    w = B.weighted_scores(spark.createDataFrame([out[0]]), threshold=5.0).collect()[0]
    assert w.score == pytest.approx(0.647619, abs=1e-6)
    assert out[0].factors == ["Unusual activity hour: 03:00", "Historical frequency: 4.8%"]


def test_time_anomaly_share_at_limit(spark):
    rows = _hour9(19) + [(19, datetime(2024, 1, 16, 3, 0), "iam_user_arn", "u", "GetObject", "10.0.0.1",
                          "us-east-1", 0)]
    assert B.behavioral_anomalies(_ee(spark, rows), mode="parity").count() == 0


def test_new_action_and_source_modes(spark):
    rows = _hour9(10) + [(10, T0 + timedelta(minutes=10), "iam_user_arn", "u", "CreateRole", "10.0.0.1",
                          "us-east-1", 0),
                         (11, T0 + timedelta(minutes=11), "iam_user_arn", "u", "GetObject", "10.9.9.9",
                          "us-east-1", 0)]
    ee = _ee(spark, rows)
    assert B.behavioral_anomalies(ee, mode="parity").count() == 0
    got = {(r.event_id, r.score) for r in B.behavioral_anomalies(ee, mode="prior").collect()}
    assert got == {(10, 9.0), (11, 6.0)}
    w = B.weighted_scores(B.behavioral_anomalies(ee, mode="prior"), 2.5).collect()
    assert sorted(round(r.score, 6) for r in w) == [1.8, 2.7]


def test_min_events_gate(spark):
    rows = _hour9(9) + [(9, T0 + timedelta(minutes=9), "iam_user_arn", "u", "CreateRole", "10.0.0.1",
                         "us-east-1", 0)]
    assert B.behavioral_anomalies(_ee(spark, rows), mode="prior").count() == 0


def _events_with_types(spark, type_lists):
    rows = []
    for i, types in enumerate(type_lists):
        ents = [(t, f"{t}-{i}-{j}") for j, t in enumerate(types)]
        rows.append((i, T0 + timedelta(seconds=i), ents))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, "
                                       "entities array<struct<entity_type:string,entity_id:string>>")


def test_rare_pair_fires_at_200(spark):
    ev = _events_with_types(spark, [["a", "b"]] * 199 + [["a", "c"]])
    out = B.rare_combinations(ev).collect()
    assert len(out) == 1 and out[0].event_id == 199
    assert out[0].score == pytest.approx(5.0) and out[0].entity_id == "a+c"
    assert out[0].factors[1] == "Frequency: 0.0050"


def test_rare_pair_not_at_100(spark):
    ev = _events_with_types(spark, [["a", "b"]] * 99 + [["a", "c"]])
    assert B.rare_combinations(ev).count() == 0


def _esc(spark, acts, minutes):
    rows = [(i, T0 + timedelta(minutes=m), "arn:aws:iam::1:user/x", a) for i, (a, m) in enumerate(zip(acts, minutes))]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_key string, action string")


def test_escalation_policy_creation(spark):
    out = B.privilege_escalation(_esc(spark, ["CreateRole", "AttachRolePolicy", "AssumeRole"], [0, 10, 20])).collect()
    hits = [(r.event_id, r.factors[0], r.score) for r in out]
    assert (2, "Privilege escalation pattern: iam_policy_creation", 10.0) in hits
    w = B.weighted_scores(B.privilege_escalation(
        _esc(spark, ["CreateRole", "AttachRolePolicy", "AssumeRole"], [0, 10, 20]))).collect()
    assert max(r.score for r in w) == pytest.approx(4.0)


def test_escalation_window_excludes_exact_lookback(spark):
    out = B.privilege_escalation(_esc(spark, ["CreateRole", "AttachRolePolicy", "AssumeRole"], [0, 10, 30]))
    assert out.where(F.col("factors")[0].contains("iam_policy_creation")).count() == 0


@pytest.mark.parametrize("acts,name,score", [
    (["AttachUserPolicy", "AttachRolePolicy"], "admin_access", 9.5),
    (["AssumeRole", "GetCredentialsForIdentity"], "cross_account_assume", 8.0),
])
def test_escalation_two_step(spark, acts, name, score):
    out = B.privilege_escalation(_esc(spark, acts, [0, 5])).collect()
    assert [(r.event_id, r.score) for r in out if name in r.factors[0]] == [(1, score)]


def test_aggregate_scores(spark):
    ev = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    rows = [(1, "privilege_escalation", 10.0, 0, 0), (1, "behavioral_deviation", 9.0 * 0 + 12.6667, 0, 1),
            (1, "time_pattern_anomaly", 5.0, 0, 2)] + [(2, "privilege_escalation", 10.0, 2, i) for i in range(10)]
    an = spark.createDataFrame(rows, "event_id long, anomaly_type string, score double, det_rank int, sub_rank int")
    an = an.withColumn("factors", F.array().cast("array<string>"))
    sc = B.weighted_scores(an, threshold=2.5)
    got = {r.event_id: r.aggregate_score for r in B.aggregate_scores(ev, sc).collect()}
    assert got[1] == pytest.approx(4.8)    # weighted 4.0, 3.8, 1.0 → 4.0 x 1.2
    assert got[2] == pytest.approx(10.0)   # ten flagged scores of 4.0, clamped
    assert got[3] == 0.0
