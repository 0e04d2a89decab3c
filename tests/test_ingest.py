import gzip
import json

import pytest
from pyspark.sql import functions as F

from logsleuth.sources import cloudtrail as CT
from logsleuth.sources import flowlogs as FL
from logsleuth.sources.files import list_log_files, read_whole_files
from logsleuth.sources.ingest import batch_summary, ingest_files
from logsleuth.operators import entities as OE

EVENT = {
    "eventVersion": "1.08", "eventTime": "2024-01-15T10:30:00Z", "eventSource": "iam.amazonaws.com",
    "eventName": "AssumeRole", "awsRegion": "us-east-1", "requestID": "req-1", "eventID": "ev-1",
    "eventType": "AwsApiCall", "recipientAccountId": "123456789012",
    "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::123456789012:user/alice",
                     "accountId": "123456789012", "userName": "alice"},
    "sourceIPAddress": "203.0.113.12", "userAgent": "aws-cli/2.0",
    "requestParameters": {"roleArn": "arn:aws:iam::123456789012:role/Admin", "durationSeconds": 3600,
                          "nested": {"ip": "10.0.0.1"}},
}
FLOW = ("version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes "
        "start end action log-status\n"
        "2 123456789012 eni-1235b8ca 172.31.16.139 172.31.16.21 20641 22 6 20 4249 1418530010 1418530070 ACCEPT OK\n"
        "2 123456789012 eni-1235b8ca 172.31.9.69 172.31.9.12 49761 3389 6 20 4249 1418530010 1418530070 REJECT OK extra\n"
        "\n"
        "2 123456789012 eni-1235b8ca - - - - - - - 1431280876 1431280934 - NODATA\n"
        "2 123 eni-1 1.1.1.1\n"
        "x 123456789012 eni-1235b8ca 1.1.1.1 2.2.2.2 1 2 6 1 1 1 2 ACCEPT OK\n")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "cloudtrail").mkdir()
    (d / "cloudtrail" / "records.json").write_text(json.dumps({"Records": [EVENT, {**EVENT, "eventID": "ev-2"}]}))
    (d / "cloudtrail" / "single.json").write_text(json.dumps(EVENT))
    bad = {k: v for k, v in EVENT.items() if k != "eventName"}
    (d / "cloudtrail" / "list.json").write_text(json.dumps([{**EVENT, "eventID": "ev-3"}, bad]))
    with gzip.open(d / "cloudtrail" / "zipped.json.gz", "wt") as f:
        json.dump({"Records": [{**EVENT, "eventID": "ev-4"}]}, f)
    (d / "cloudtrail" / "broken.json").write_text("{not json")
    (d / "flows").mkdir()
    (d / "flows" / "vpc-flow.log").write_text(FLOW)
    (d / "other").mkdir()
    (d / "other" / "unknown.txt").write_text(FLOW.split("\n", 1)[1])
    (d / "other" / "unknown.json").write_text(json.dumps(EVENT))
    return d


def test_parse_shapes_and_rejects(spark, files):
    raw = read_whole_files(spark, str(files / "cloudtrail" / "*"))
    parsed = CT.parse_cloudtrail_text(raw)
    ok = CT.valid(parsed)
    ids = sorted(r.eventID for r in ok.collect())
    assert ids == ["ev-1", "ev-1", "ev-2", "ev-3", "ev-4"]
    rej = CT.rejected(parsed).collect()
    msgs = sorted(m for r in rej for m in r.errors)
    assert "Invalid JSON in CloudTrail log" in msgs
    assert "eventName: field required" in msgs
    row = ok.where("eventID = 'ev-2'").collect()[0]
    assert row.userIdentity.userName == "alice" and row.eventTime.year == 2024


def test_entities_from_parsed_event(spark, files):
    ok = CT.valid(CT.parse_cloudtrail_text(read_whole_files(spark, str(files / "cloudtrail" / "single.json"))))
    ents = OE.explode_entities(OE.cloudtrail_entities(ok)).collect()
    got = {(e.entity_type, e.entity_id, e.source_field, round(e.confidence, 6)) for e in ents}
    assert ("iam_user_arn", "arn:aws:iam::123456789012:user/alice", "userIdentity.arn", 0.8) in got
    assert ("ip_address", "203.0.113.12", "sourceIPAddress", 0.95) in got
    assert ("iam_role_arn", "arn:aws:iam::123456789012:role/Admin", "requestParameters.roleArn", 1.0) in got
    assert not any(e.entity_id == "10.0.0.1" for e in ents)  # nested objects are not scanned


def test_flow_parse(spark, files):
    raw = read_whole_files(spark, str(files / "flows" / "vpc-flow.log"))
    parsed = FL.parse_flow_text(raw)
    ok = FL.valid(parsed).orderBy("line_number").collect()
    assert [r.action for r in ok] == ["ACCEPT", "REJECT"]
    assert ok[1].dstport == 3389
    errs = {r.error for r in FL.rejected(parsed).collect()}
    assert "no_data" in errs and "Insufficient fields (4 < 14)" in errs
    assert any(e.startswith("Parse error") for e in errs)
    ents = OE.explode_entities(OE.flow_entities(FL.valid(parsed).where("line_number = 2"))).collect()
    got = {(e.entity_type, e.entity_id, e.source_field) for e in ents}
    assert got == {("ip_address", "172.31.16.139", "srcaddr"), ("ip_address", "172.31.16.21", "dstaddr"),
                   ("ec2_instance_id", "i-1235b8ca", "interface_id"),
                   ("iam_role_arn", "123456789012", "account_id")}


def test_format_detection(spark, files):
    raw = CT.detect_format(read_whole_files(spark, [str(files / "flows" / "*"), str(files / "other" / "*"),
                                                    str(files / "cloudtrail" / "single.json")]))
    got = {r.path.rsplit("/", 1)[-1]: r.event_source for r in raw.collect()}
    assert got == {"vpc-flow.log": "vpc_flow", "unknown.txt": "vpc_flow", "unknown.json": "cloudtrail",
                   "single.json": "cloudtrail"}


def test_ingest_manifest(spark, files):
    paths = [str(files / "cloudtrail" / n) for n in ("records.json", "broken.json")] + \
            [str(files / "flows" / "vpc-flow.log")]
    ev, fl, man, errs = ingest_files(spark, paths, bucket="b")
    rows = {r.source_key.rsplit("/", 1)[-1]: r for r in man.collect()}
    assert rows["records.json"].log_count == 2
    assert rows["records.json"].batch_id.startswith("s3-b-") and "/" not in rows["records.json"].batch_id
    assert rows["broken.json"].log_count == 0 and rows["broken.json"].error_count == 1
    assert any("Invalid JSON" in r.error for r in errs.collect())
    assert rows["vpc-flow.log"].log_count == 2
    assert rows["records.json"].size_bytes == len((files / "cloudtrail" / "records.json").read_bytes())
    s = batch_summary(man).collect()[0]
    assert s.total_events == 4 and s.files_processed == 3


def test_list_files(spark, files):
    out = list_log_files(spark, str(files), prefix="cloudtrail/").collect()
    keys = [r.key for r in out]
    assert keys == sorted(keys) and all(k.startswith("cloudtrail/") for k in keys) and len(keys) == 5
    assert len(list_log_files(spark, str(files), max_files=2).collect()) == 2


def test_queue_messages(spark):
    msg = json.dumps({"Records": [{"body": json.dumps(EVENT)}, {"body": json.dumps({"foo": 1})},
                                  {"body": "not json"}]})
    df = spark.createDataFrame([(msg,)], "value string")
    st = sorted(r.status for r in CT.queue_messages(df).collect())
    assert st == ["rejected", "skipped", "valid"]
