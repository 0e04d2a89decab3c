"""Every operator and stage on nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""
import pytest

import corpus_pipeline
from logsleuth.llm import decontaminate, exact_dedup, licenses, mixing, pii, quality, secret_scan, simhash
from logsleuth.llm import substring_dedup, token_counts
from logsleuth.llm.suite import tokenizer_path

LONG = "word soup with a number 12345 and mail a@b.example.org " * 40 + "word soup with a number 12345 " * 20_000  # 0.6 MB
ITEMS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (5, "one two three four"), (5, "one two three four"),
         (6, LONG), (7, LONG), (None, "a row without an id"), (8, "x" * 100_000), (9, "\U0001F600 café token = abcdef123")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (4, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word soup with a number 12345 and mail and more text here"), (2, None), (3, ""),
                                  (3, "")], "item_id long, text string")


def operators(labels):
    return {
        "mix": lambda d: mixing.mix(d, {"src0": 3, "src1": 2}),
        "quality": lambda d: quality.classify(d, labels),
        "pii": lambda d: pii.pii_spans(d),
        "tokens": lambda d: token_counts.token_counts(d, tokenizer_path()),
        "substring": lambda d: substring_dedup.substring_dedup(d),
        "secrets": lambda d: secret_scan.secret_spans(d),
        "exact": lambda d: exact_dedup.exact_dedup(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "license": lambda d: licenses.license_scan(d.selectExpr("*", "concat('a/', doc_id) AS path"), "path"),
    }


@pytest.mark.parametrize("name", ["mix", "quality", "pii", "tokens", "substring", "secrets", "exact", "simhash", "license"])
def test_one_row_per_input_row(name, make, labels):
    op = operators(labels)[name]
    out = op(make(ITEMS))
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((i is None, i or 0) for i, *_ in ITEMS)
    assert op(make([(1, "x")]).limit(0)).count() == 0


def test_overlaps(make, bench):
    found = decontaminate.overlaps(make(ITEMS), bench).collect()
    assert not [r for r in found if r["doc_id"] not in (6, 7)]
    assert decontaminate.overlaps(make(ITEMS), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(make([(1, "x")]).limit(0), bench).count() == 0


def test_defined_results(make, labels):
    docs = make(ITEMS)
    exact = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(1, 3, 3), (2, 3, 3), (3, 3, 3), (4, 4, 3), (5, 4, 3), (6, 6, 2), (7, 6, 2), (None, None, 1)} <= exact
    kept = [r for r in exact_dedup.exact_dedup(make([(5, "a b"), (5, "a b")])).collect() if r["kept"]]
    assert len(kept) == 1 and kept[0]["group_size"] == 2
    sim = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sim[1] == sim[2] == sim[3] == (0, 1) and sim[7][1] == 6 and sim[5][1] == 4
    sub = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert sub[1] == (0, 0) and sub[5] == (4, 0) and sub[6][1] == 0 and sub[7][1] == sub[7][0] == len(LONG.split())
    tok = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in token_counts.token_counts(docs, tokenizer_path()).collect()}
    assert tok[1] == tok[2] == (0, 0, False) and tok[7][2]
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_stages(spark, make, tmp_path, labels, bench):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (make(ITEMS), make([(1, "x")]).limit(0)):
        n = docs.count()
        for i, (_, fn) in enumerate(corpus_pipeline.STAGES):
            out = fn(spark, docs, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns
            assert out.count() <= n
    one = corpus_pipeline.exact_stage(spark, make(ITEMS), str(tmp_path)).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in one) == [0, 3, 4, 6, 8, 9]
