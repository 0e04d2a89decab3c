import json
import os

from pyspark.sql import functions as F

from logsleuth.operators import behavior as B
from logsleuth.session import checkpoint_dir
from logsleuth.streaming import detectors as SD
from logsleuth.streaming.runner import run_available_now, stream_files

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark):
    s = stream_files(spark, SF, SCHEMA, glob="events.parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"),
                    F.get_json_object("props", "$.k").alias("source"),
                    F.col("user_id").cast("string").alias("user_key"))


def _batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"),
                     F.get_json_object("props", "$.k").alias("source"),
                     F.col("user_id").cast("string").alias("user_key"))


def test_profile_stream_equals_batch(spark):
    for mode in ("parity", "prior"):
        s = _stream(spark).select("event_id", "ts", F.lit("user").alias("entity_type"),
                                  F.col("user_key").alias("entity_id"), "action", "source")
        got = run_available_now(SD.profile_detector_stream(s, mode=mode), f"prof_{mode}")
        b = _batch(spark).select("event_id", "ts", F.lit("user").alias("entity_type"),
                                 F.col("user_key").alias("entity_id"), "action", "source",
                                 F.lit("0").alias("region"), F.lit(0).alias("ent_ord"))
        want = B.behavioral_anomalies(b, mode=mode)
        key = lambda r: (r.event_id, r.anomaly_type, round(r.score, 6), tuple(r.factors))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_escalation_stream_equals_batch(spark):
    pats = {"signup_to_purchase": (["signup", "purchase"], 8.0)}
    got = run_available_now(SD.escalation_stream(_stream(spark), patterns=pats, lookback_minutes=1440), "esc")
    want = B.privilege_escalation(_batch(spark), "user_key", "action", pats, 1440)
    g = sorted((r.event_id, r.score, r.factors[1]) for r in got.collect())
    w = sorted((r.event_id, r.score, r.factors[1]) for r in want.collect())
    assert g == w and len(g) > 0


def test_tumbling_alarm_stream(spark):
    s = _stream(spark)
    out = run_available_now(
        SD.tumbling_alarm(s, "ts", F.when(F.col("action") == "error", 1).otherwise(0), "1 day", "1 minute"),
        "alarm")
    b = SD.tumbling_alarm(_batch(spark), "ts", F.when(F.col("action") == "error", 1).otherwise(0), "1 day")
    got = {r.period_start: r.value for r in out.collect()}
    want = {r.period_start: r.value for r in b.collect()}
    # append mode emits windows closed by the watermark: all but the last
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 1


def test_enrich_stream_and_dedupe(spark, tmp_path):
    ev = {"eventVersion": "1.08", "eventTime": "2024-01-15T10:30:00Z", "eventSource": "iam.amazonaws.com",
          "eventName": "AssumeRole", "awsRegion": "us-east-1", "requestID": "r", "eventID": "e1",
          "eventType": "AwsApiCall", "recipientAccountId": "123456789012",
          "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::123456789012:user/alice"},
          "sourceIPAddress": "203.0.113.12"}
    d = tmp_path / "msgs"
    d.mkdir()
    (d / "m1.txt").write_text(json.dumps({"Records": [{"body": json.dumps(ev)}, {"body": "{}"}]}) + "\n")
    s = spark.readStream.format("text").load(str(d))
    out = run_available_now(SD.enrich_stream(s), "enrich").collect()
    assert len(out) == 1 and out[0].log_id == "e1" and out[0].risk_level == "low"
    assert "Validate source IP addresses against allowed network ranges" in out[0].recommendations


def test_combination_state_snapshots(spark):
    root = os.path.join(checkpoint_dir(spark), "combo-test")
    t = "array<struct<entity_type:string,entity_id:string>>"
    b0 = spark.createDataFrame([(1, "x", [("a", "1"), ("b", "2")])], f"event_id long, action string, entities {t}")
    b1 = spark.createDataFrame([(2, "x", [("a", "1"), ("b", "3")]), (3, "y", [("c", "4")])],
                               f"event_id long, action string, entities {t}")
    SD.combination_batch_update(b0, 0, root)
    st = {(r.family, r.key): r["count"] for r in SD.combination_batch_update(b1, 1, root).collect()}
    assert st[("types", "('a', 'b')")] == 2 and st[("total", "")] == 2


def test_combination_state_deltas(spark, tmp_path):
    """A batch writes its own counts; compaction folds them; a repeated batch changes nothing."""
    t = "array<struct<entity_type:string,entity_id:string>>"
    root = str(tmp_path / "state")
    batches = [spark.createDataFrame([(i, "x", [("a", str(j)), ("b", str(i))]) for j in range(3)],
                                     f"event_id long, action string, entities {t}") for i in range(5)]
    counts = lambda df: {(r.family, r.key): r["count"] for r in df.collect()}
    for i, b in enumerate(batches):
        got = counts(SD.combination_batch_update(b, i, root, compact_every=2))
        assert got[("total", "")] == 3 * (i + 1) == counts(SD.combination_state(spark, root))[("total", "")]
    assert got == counts(SD.combination_batch_update(batches[4], 4, root, compact_every=2))
    assert counts(SD.combination_state(spark, root, before=3))[("total", "")] == 9
    assert sorted(os.listdir(f"{root}/base")) == ["batch=1", "batch=3"] and len(os.listdir(f"{root}/delta")) == 5
    delta = spark.read.parquet(f"{root}/delta/batch=4")
    assert counts(delta) == counts(SD.combination_batch_update(batches[4], 0, str(tmp_path / "fresh")))


def test_batches_of_many_files(spark):
    from logsleuth.streaming.runner import time_ordered_files, write_batches
    ev = spark.range(1000).selectExpr("id", "timestamp_seconds(id * 60) AS ts").unionByName(
        spark.sql("SELECT -1L AS id, CAST(NULL AS timestamp) AS ts"))
    root, files = time_ordered_files(ev, "ts", "many")
    assert files == 1 and spark.read.parquet(root).count() == 1001
    root, files = write_batches([ev.where("id % 2 = 0"), ev.where("id % 2 = 1"), ev.where("id < -5")], "many", rows_per_file=150)
    assert files == 4 and spark.read.parquet(root).count() == 1000
    seen = []
    s = stream_files(spark, root, "id bigint, ts timestamp", max_files_per_trigger=files)
    s.writeStream.foreachBatch(lambda b, i: seen.append({r.id % 2 for r in b.collect()})).option(
        "checkpointLocation", f"{root}-chk").trigger(availableNow=True).start().awaitTermination()
    assert seen == [{0}, {1}]


def test_profile_state_beyond_inline_values(spark, monkeypatch):
    """Actions and sources beyond the inline part of a profile are still seen once,
    and a batch makes one read and one write of a small profile."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.v, self.calls = None, 0

        def exists(self):
            return self.v is not None

        def get(self):
            self.calls += 1
            return self.v

        def update(self, v):
            self.calls += 1
            self.v = v

    class Map(dict):
        def containsKey(self, k):
            return k in self

        def updateValue(self, k, v):
            self[k] = v

    class Handle:
        def __init__(self):
            self.value, self.maps = Value(), {"actions": Map(), "sources": Map()}

        def getValueState(self, name, schema):
            return self.value

        def getMapState(self, name, *schemas):
            return self.maps[name]

    monkeypatch.setattr(SD.ProfileDetector, "INLINE", 3, raising=False)
    d, h = SD.ProfileDetector("prior", 1, None), Handle()
    d.init(h)

    def batch(first, sources):
        ids = range(first, first + len(sources))
        rows = pd.DataFrame({"ts": pd.to_datetime([i * 60 for i in ids], unit="s"), "event_id": list(ids),
                             "action": ["a"] * len(sources), "source": sources})
        out = [r for f in d.handleInputRows(("user", "u"), iter([rows]), None) for r in f.itertuples()]
        return [r.factors[0][-2:] for r in out if r.score == SD.B.NEW_SOURCE_SCORE]

    assert batch(0, [f"s{i}" for i in range(6)]) == ["s1", "s2", "s3", "s4", "s5"]
    assert batch(6, ["s5", "s0", "s6", None, "", "s6"]) == ["s6"]
    assert len(h.maps["sources"]) == 4 and not h.maps["actions"] and h.value.calls == 3
