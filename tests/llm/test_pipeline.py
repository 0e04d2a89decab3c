"""The pipeline against its stages done in plain Python."""
import pytest

import corpus_pipeline
from logsleuth.llm import quality, suite

from conftest import DOC_SCHEMA, SF
from test_brute_force import plain_overlaps, plain_simhash


def test_pipeline(spark, docs, rows):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"] == 1}
    kept = {i: t for i, t, *_ in rows if i in good}
    best = {}
    for i, t in sorted(kept.items()):
        n = "".join((t or "").split())
        if n not in best or len(t) > len(kept[best[n]]):
            best[n] = i
    kept = {i: kept[i] for i in best.values()}
    fps = {i: plain_simhash(t) for i, t in kept.items()}
    group = {}
    for i in sorted(fps):
        if i in group:
            continue
        todo, group[i] = [i], i
        while todo:
            x = todo.pop()
            for j in fps:
                if j not in group and bin(fps[x] ^ fps[j]).count("1") <= 3:
                    group[j] = i
                    todo.append(j)
    kept = {i: kept[i] for i in set(group.values())}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in plain_overlaps(list(kept.items()), bench)}
    want = set(kept) - bad
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert sorted(r["position"] for r in got) == list(range(len(want)))
    assert {"text", "lang", "source", "n_chars"} <= set(out.columns)
    slot = {}
    for r in got:
        slot.setdefault((r["phase"], r["slot"]), set()).add(r["mix_source"])
    assert all(len(s) == 1 for s in slot.values())
    assert [n for n, _ in corpus_pipeline.STAGES] and set(suite.QUERIES)


def test_rows_with_null_and_equal_ids(spark, make, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    items = [(None, texts["a"]), (None, f"x {passage} y"), (None, texts["b"]), (7, texts["c"]), (7, f"z {passage}"), (8, texts["d"])]
    left = corpus_pipeline.decontaminate_stage(spark, make(items), str(tmp_path))
    key = lambda rows: sorted((r[0] or 0, r[1]) for r in rows)
    assert key(left.select("doc_id", "text").collect()) == key([items[0], items[2], items[3], items[5]])
    # groups: all ids null; a null and an id; equal ids in different groups and in one
    items = [(None, texts["a"]), (None, texts["a"]), (None, texts["b"]), (3, texts["b"]), (4, texts["c"]), (4, texts["d"]),
             (4, texts["d"]), (5, texts["c"]), (None, texts["e"])]
    left = corpus_pipeline.simhash_stage(spark, make(items), str(tmp_path))
    assert key(left.select("doc_id", "text").collect()) == key([items[0], items[3], items[4], items[5], items[8]])
    assert "_llm_row" not in left.columns


def test_columns_of_the_pipelines_own_names_come_back(spark, make, tmp_path):
    """Input columns named like helper columns keep their values through each stage."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "words of a benchmark item that no text here holds at all")], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make([(i, f"text number {i} with words of its own w{i} x{i} y{i}") for i in range(8)])
    for c in ("_llm_row", "_llm_digest", "_llm_order", "_llm_predicted", "_k0"):
        docs = docs.selectExpr("*", f"concat('{c}', doc_id) AS `{c}`")
    for name, fn in corpus_pipeline.STAGES[:4]:
        out = fn(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert r["_llm_row"] == f"_llm_row{r['doc_id']}" and r["_llm_digest"] == f"_llm_digest{r['doc_id']}", name
            assert r["_k0"] == f"_k0{r['doc_id']}" and r["_llm_predicted"] == f"_llm_predicted{r['doc_id']}"


@pytest.mark.parametrize("most", [1 << 14, 0])
def test_places_of_copies_are_bits(spark, tmp_path, monkeypatch, most):
    """Files of more rows than a bitmap marks, texts that are null or empty, ids that come
    twice: the first of each group of copies stays, known by a few rows, broadcast or not."""
    texts = [None if i % 97 == 0 else "" if i % 89 == 0 else f"text {i - i % 3 if i % 7 < 4 else i}" for i in range(40_000)]
    folder = str(tmp_path / "documents of many.parquet")
    for lo, hi in ((0, 36_000), (36_000, 40_000)):
        spark.createDataFrame([(i - i % 2, t, "en", "src0", i) for i, t in enumerate(texts[lo:hi], lo)],
                              DOC_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    docs, sizes, plain = spark.read.parquet(folder), {}, corpus_pipeline.stage

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(corpus_pipeline, "stage", counted)
    monkeypatch.setattr(corpus_pipeline, "BITMAPS", most, raising=False)
    left = corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect()
    best = {}
    for i, t in enumerate(texts):
        best.setdefault((t or "").replace(" ", ""), i - i % 2)
    assert sorted((r["text"] or "").replace(" ", "") for r in left) == sorted(best)
    assert {(r["text"] or "").replace(" ", ""): r["doc_id"] for r in left} == best
    assert all(texts[r["n_chars"]] == r["text"] and r["n_chars"] // 2 * 2 == r["doc_id"] for r in left)
    assert 2 <= sizes["exact-dropped"] <= 3
