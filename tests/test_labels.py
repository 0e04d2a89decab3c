from pyspark.sql import functions as F

from logsleuth.operators import labels as LB


def test_tokenize_and_auto_labels(spark):
    text = "User alice@example.com called arn:aws:iam::123456789012:role/AdminRole from 10.0.0.1."
    df = spark.createDataFrame([(text,)], "text string")
    df = df.withColumn("tokens", LB.tokenize(F.col("text")))
    df = df.withColumn("sug", LB.suggest_labels(F.col("text")))
    df = df.withColumn("labels", LB.auto_labels(F.col("tokens"), F.col("sug")))
    r = df.collect()[0]
    assert r.tokens == ["User", "alice@example.com", "called", "arn:aws:iam::123456789012:role", "/",
                        "AdminRole", "from", "10.0.0.1."]
    got = dict(zip(r.tokens, r.labels))
    assert got["alice@example.com"] == "B-USER"
    assert got["arn:aws:iam::123456789012:role"] == "B-RESOURCE"   # the generic ARN suggestion comes later
    assert got["AdminRole"] in ("I-RESOURCE", "B-ROLE")
    spans = df.select(LB.bio_spans(F.col("tokens"), F.col("labels")).alias("s")).collect()[0].s
    assert spans[0].etype == "USER" and spans[0].text == "alice@example.com"


def test_bio_issues_and_quality(spark):
    rows = [(0, ["a", "b", "c"], ["O", "I-IP", "O"]),            # invalid I-
            (1, ["a", "b"], ["O", "O"]),                           # all O -> warning
            (2, ["a"], ["B-X", "O"]),                               # mismatch + unknown label
            (3, ["t"] * 12, ["B-IP"] + ["I-IP"] * 11)]              # long entity: 2 warnings
    df = spark.createDataFrame(rows, "index int, tokens array<string>, labels array<string>")
    q = LB.quality_report(df).collect()[0]
    assert (q.issues, q.warnings) == (3, 3)
    assert q.quality_score == max(0, 100 - 30 - 6)
    msgs = LB.validation_messages(df).collect()
    kinds = sorted(m.kind for m in msgs)
    assert kinds.count("issue") == 3 and kinds.count("warning") == 3
    assert "Example 4: Very long entity (12 tokens)" in {m.message for m in msgs}
    assert any(m.message == "Example 1, Token 2: Invalid I- tag without preceding B- tag" for m in msgs)


def test_spans_to_bio_and_align(spark):
    df = spark.createDataFrame([("ip 10.0.0.1 seen", [(3, 11, "IP_ADDRESS")])],
                               "text string, spans array<struct<start:int,end:int,label:string>>")
    lab = df.select(LB.spans_to_bio(F.col("text"), F.col("spans")).alias("l")).collect()[0].l
    assert lab == ["O", "B-IP_ADDRESS", "O"]
    out = spark.range(1).select(LB.align_labels(F.array(F.lit("B-X")), F.lit(3)).alias("a")).collect()[0].a
    assert out == ["B-X", "O", "O"]
    ids = spark.range(1).select(LB.label_ids(F.array(F.lit("O"), F.lit("B-IP_ADDRESS"))).alias("i")).collect()[0].i
    assert ids == [0, 5]


def test_weak_spans_and_metrics(spark):
    df = spark.createDataFrame([("x arn:aws:iam::1:role/R y 1.2.3.4", "arn:aws:iam::1:role/R", "1.2.3.4")],
                               "t string, arn string, ip string")
    sp = df.select(LB.weak_spans(F.col("t"), F.col("arn"), F.col("ip")).alias("s")).collect()[0].s
    assert [(s.start, s.end, s.label) for s in sp] == [(2, 23, "IAM_ROLE_ARN"), (26, 33, "IP_ADDRESS")]
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("-100", "A")], "label string, predicted string")
    m = LB.token_metrics(pairs).collect()[0]
    # A: p=1, r=.5, f=2/3 (support 2); B: p=.5, r=1, f=2/3 (support 1)
    assert abs(m.precision - (2 * 1 + 1 * 0.5) / 3) < 1e-9 and abs(m.f1 - 2 / 3) < 1e-9
    assert abs(m.accuracy - 2 / 3) < 1e-9


def test_upsert_and_split(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "index int, text string")
    upd = spark.createDataFrame([(2, "B"), (3, "c")], "index int, text string")
    got = sorted(tuple(r) for r in LB.upsert_examples(store, upd).collect())
    assert got == [(1, "a"), (2, "B"), (3, "c")]
    sp = spark.range(1000).select(LB.split_assign(F.col("id")).alias("s")).groupBy("s").count().collect()
    counts = {r.s: r["count"] for r in sp}
    assert set(counts) == {"train", "validation", "test"} and counts["train"] > counts["test"]
