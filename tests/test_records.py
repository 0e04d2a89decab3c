"""Record-boundary scan of audit files against the parse of whole files."""
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from logsleuth.sources import cloudtrail as CT
from logsleuth.sources import records as R
from logsleuth.sources.files import list_log_files, read_whole_files
from logsleuth.sources.ingest import batch_summary, ingest_files, ingest_listing, read_json_documents

from test_ingest import EVENT, FLOW


def _events(n, seed=0):
    rnd = random.Random(seed)
    odd = ['a,b', 'q"uo,te"', 'back\\', '\\",[', '{"Records":[1,2]}', '}]', 'naïve \U0001F600', '', 'line\nbreak,']
    out = []
    for i in range(n):
        e = {**EVENT, "eventID": f"ev-{i}", "userAgent": rnd.choice(odd), "requestID": rnd.choice(odd) + str(i),
             "requestParameters": {"Records": [rnd.choice(odd), {"x": [1, [2]]}], rnd.choice(odd): rnd.choice(odd)}}
        if i % 7 == 3:
            del e["eventName"]
        out.append(e)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    ev = _events(200)
    texts = {
        "records": json.dumps({"Records": ev}), "spaced": json.dumps({"Records": ev}, indent=2) + "\n",
        "compact": json.dumps({"Records": ev}, separators=(",", ":")), "list": json.dumps(ev),
        "around": json.dumps({"meta": {"Records": [1, 2], "k": "Records"}, "Records": ev, "z": [1, {"a": "]"}]}),
        "single": json.dumps(ev[0]), "one": json.dumps([ev[1]]), "empty_list": "[ ]", "empty": json.dumps({"Records": []}),
        "scalars": json.dumps([1, "x", None, [2], {"a": 1}]), "no_array": json.dumps({"Records": {"a": 1}}),
        "number": "17", "text": '"a, b"', "broken": "{not, json", "cut": json.dumps({"Records": ev})[:-300],
        "unclosed": json.dumps({"Records": ev})[:-1], "comma": '{"Records":[{"a":1},]}', "gap": '[{"a":1},,{"b":2}]',
        "twice": '{"Records":[{"a":1}],"Records":[{"b":2}]}', "tail": json.dumps(ev[:3]) + " x", "two": '[1,2][3,4]',
        "bad_record": '{"Records":[{"a":1},{"b":nope},{"c":3}]}', "blank": "  \n ",
    }
    for name, text in texts.items():
        (d / f"{name}.json").write_text(text)
    with gzip.open(d / "zipped.json.gz", "wt") as f:
        f.write(texts["around"])
    return d


def _rows(parsed):
    cols = [c for c in parsed.columns if c not in ("path",)]
    text = [F.to_json(F.struct(*[c for c in cols])).alias("row")]
    out = {}
    for r in parsed.select("path", *text).collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.row)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size,split", [(37, "3000b"), (1 << 18, None)])
def test_equal_to_whole_files_cut_anywhere(spark, folder, size, split, monkeypatch):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        whole = CT.parse_cloudtrail_text(read_whole_files(spark, str(folder)).drop("file_size"))
        whole = whole.withColumn("record_index", F.col("record_index").cast("long"))
        parts = R.fragments(spark, str(folder), whole_bytes=0)
        if split:
            assert parts.select("path", "block").distinct().count() > 40
        got = CT.parse_split_records(R.split_records(parts, size))
        assert got.columns == whole.columns
        want, got = _rows(whole), _rows(got)
        assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
        assert got == want
    finally:
        if split:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents_and_ingest_do_not_depend_on_the_bound(spark, folder, tmp_path):
    for name in ("records", "around", "list", "cut"):
        (tmp_path / f"{name}.json").write_bytes((folder / f"{name}.json").read_bytes())
    (tmp_path / "zipped.json.gz").write_bytes((folder / "zipped.json.gz").read_bytes())
    (tmp_path / "vpc-flow.log").write_text(FLOW)
    outs = []
    for whole_bytes in (R.WHOLE_BYTES, 40_000, 0):
        _, _, manifest, errors = ingest_files(spark, str(tmp_path), bucket="b", whole_bytes=whole_bytes)
        rows = sorted(tuple(r) for r in manifest.drop("created_at", "size_bytes").collect())
        kinds = sorted((r.path.rsplit("/", 1)[-1], r.error.split(": ")[-1]) for r in errors.collect())
        docs = sorted(r.eventID for r in CT.valid(read_json_documents(spark, f"{tmp_path}/*.json*", whole_bytes=whole_bytes)).collect())
        listing = list_log_files(spark, str(tmp_path), "r")
        total = batch_summary(ingest_listing(spark, str(tmp_path), listing, whole_bytes=whole_bytes)[2]).collect()
        sizes = {r.source_key.rsplit("/", 1)[-1]: r.size_bytes for r in manifest.collect() if r.event_source == "cloudtrail"}
        outs.append((rows, kinds, docs, total, sizes))
    assert outs[0] == outs[1] == outs[2] and len(outs[0][2]) > 600


def test_a_file_above_the_variant_limit(spark, tmp_path):
    """A file of 300 MB, above the limit of a VARIANT, keeps all its records."""
    filler = "x.y, " + "x. " * 1500
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"Records":[')
        for i in range(66_000):
            f.write(("," if i else "") + '{"eventID":"e%d","userAgent":"%s"}' % (i, filler))
        f.write("]}")
    assert (tmp_path / "big.json").stat().st_size > 290_000_000
    got = read_json_documents(spark, str(tmp_path / "big.json"))
    row = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("eventID").alias("ids"), F.max("record_index").alias("last"),
                  F.sum(F.length("userAgent")).alias("chars")).first()
    assert tuple(row) == (66_000, 66_000, 65_999, 66_000 * len(filler))
