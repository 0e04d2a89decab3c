import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from logsleuth.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", shuffle_partitions=2)
    checkpoint_dir(s)
    # many small plans: compiling each would take most of the time
    old = s.conf.get("spark.sql.codegen.wholeStage")
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    s.conf.set("spark.sql.codegen.wholeStage", old)
    s.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with extra columns of
    names that the operators use inside."""
    def build(items):
        full = [(i, t, *(rest or ("en", "src0")), len(t or "")) for i, t, *rest in items]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        for c in ("id", "fp", "score", "spans", "digest", "rank", "kind", "label", "block", "anchor", "_row", "w1"):
            df = df.selectExpr("*", f"'clash' AS `{c}`")
        return df
    return build
