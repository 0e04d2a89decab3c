import pytest
from pyspark.sql import functions as F

from logsleuth.operators import enrich as EN
from logsleuth.operators import govern as GV

SC = "array<struct<score:double,factors:array<string>,threshold:double,is_anomaly:boolean>>"


@pytest.mark.parametrize("scores,level", [([1.0, 2.0], "low"), ([4.0, 6.0], "medium"),
                                          ([8.0, 9.0], "high"), ([], "low")])
def test_risk_levels(spark, scores, level):
    df = spark.createDataFrame([([(s, [], 5.0, False) for s in scores],)], f"s {SC}")
    assert df.select(EN.risk_level(F.col("s"))).collect()[0][0] == level


def test_recommendations(spark):
    ent_t = "array<struct<entity_type:string,entity_id:string>>"
    df = spark.createDataFrame([([], []), ([("iam_role_arn", "r"), ("ip_address", "1.1.1.1")], [(8.0, [], 5.0, True)])],
                               f"e {ent_t}, s {SC}")
    recs = [r[0] for r in df.select(EN.recommendations(F.col("e"), F.col("s"))).collect()]
    assert recs[0] == [EN.REC_NONE]
    assert recs[1] == [EN.REC_HIGH_RISK, EN.REC_IAM, EN.REC_IP]


CFG = "bucket string, expiration_days int, transitions array<struct<days:int,storage_class:string>>, " \
      "lock_enabled boolean, lock_years int, sse_algorithm string"


def test_bucket_validation(spark):
    t3 = [(30, "STANDARD_IA"), (365, "GLACIER"), (1095, "DEEP_ARCHIVE")]
    cfg = spark.createDataFrame([("sec-logs", 2555, t3, True, 7, "aws:kms"),
                                 ("sec-logs-short", 365, t3, True, 7, "aws:kms")], CFG)
    v = {r.bucket: r for r in GV.validate_buckets(cfg, GV.policy_table(spark)).collect()}
    assert v["sec-logs"].compliant
    assert not v["sec-logs-short"].compliant
    assert v["sec-logs-short"].issues[0].startswith("Retention period 365 days is less than required 2555")


def test_compliance_report(spark):
    val = spark.createDataFrame([("a", True, []), ("b", False, ["No encryption configuration found"])],
                                "bucket string, compliant boolean, issues array<string>")
    gb = 1024 ** 3
    met = spark.createDataFrame([("a", int(50 / 0.023 * gb)), ("b", int(30 / 0.023 * gb))],
                                "bucket string, total_size_bytes long").withColumn(
        "cost_estimate_monthly", F.col("total_size_bytes") / F.lit(float(gb)) * 0.023)
    r = GV.compliance_report(val, met).collect()[0]
    assert r.compliance_rate == 0.5 and r.total_cost_monthly == pytest.approx(80.0, abs=1e-6)
    assert r.n_critical_issues >= 1 and r.recommendations == [GV.REC_REVIEW]


def test_storage_class_for_age(spark):
    t = [(30, "STANDARD_IA"), (365, "GLACIER")]
    df = spark.createDataFrame([(a, t) for a in (0, 30, 400)], "age int, t array<struct<days:int,storage_class:string>>")
    got = [r[0] for r in df.select(GV.storage_class_for_age(F.col("age"), F.col("t"))).collect()]
    assert got == ["STANDARD", "STANDARD_IA", "GLACIER"]


def test_reconcile(spark):
    au = spark.createDataFrame([("r1", True, "RECOMMENDED", None), ("r2", False, "RECOMMENDED", None)],
                               "recommendation_id string, applied boolean, status string, reconciled_at timestamp")
    updated, summary = GV.reconcile(au)
    s = summary.collect()[0]
    assert (s.scanned, s.reconciled, s.missing) == (2, 1, 1)
    st = {r.recommendation_id: r.status for r in updated.collect()}
    assert st == {"r1": "RECONCILED", "r2": "RECOMMENDED"}


def test_versioned_merge_survives_a_half_written_version(spark, tmp_path):
    """Only touched buckets are written; a version without its manifest is not seen."""
    import os

    from logsleuth.operators import govern as GV
    root, schema = str(tmp_path / "audit"), "recommendation_id string, status string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda version=None: {tuple(r) for r in GV.read_audit(spark, root, schema, version).collect()}
    first = [(f"r{i}", "RECOMMENDED") for i in range(200)] + [(None, "odd")]
    assert GV.merge_audit(make(first), root, buckets=16) == 0 and rows() == set(first)
    change = [("r3", "RECONCILED"), ("new", "RECOMMENDED"), (None, "even")]
    assert GV.merge_audit(make(change), root, buckets=16) == 1
    after = (set(first) - {("r3", "RECOMMENDED"), (None, "odd")}) | set(change)
    assert rows() == after and rows(0) == set(first)
    assert len([d for d in os.listdir(f"{root}/data/v=1") if d.startswith("_bucket=")]) <= 3
    # a run that stopped before its manifest: data of version 2 lies there
    make([("r5", "LOST")]).selectExpr("*", "1 AS _bucket").write.partitionBy("_bucket").parquet(f"{root}/data/v=2")
    assert GV.audit_versions(spark, root) == [0, 1] and rows() == after
    assert GV.merge_audit(make([("r5", "RECONCILED")]), root, buckets=16) == 2
    assert rows() == (after - {("r5", "RECOMMENDED")}) | {("r5", "RECONCILED")}
    assert GV.merge_audit(make([]), root, buckets=16) == 3 and len(rows()) == 202


def test_words_of_long_texts(spark):
    from logsleuth.operators import labels as LB
    text = "  one  two\tthree \n" + "w " * 30_000 + "end"
    df = spark.createDataFrame([(text,), ("",), ("  ",), ("a",)], "t string")
    got = [r[0] for r in df.select(LB.words_with_offsets(F.col("t"))).collect()]
    assert all(text[w.s:w.s + len(w.w)] == w.w for w in got[0]) and len(got[0]) == 30_004
    assert got[1] == [] and got[2] == [] and [tuple(w) for w in got[3]] == [("a", 0)]
    one = [r[0] for r in df.select(LB.words_with_offsets(F.col("t"), single_space=True)).collect()]
    assert [tuple(w) for w in one[0][:3]] == [("one", 0), ("two", 4), ("three", 8)] and one[1] == []
