"""Plans whose tasks and shuffles must not follow a group, a file or a table's bytes."""

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from logsleuth.operators import behavior as B
from logsleuth.operators import series as S
from logsleuth.plans.ranking import balanced_segments
from logsleuth.plans.spread import by_rows
from logsleuth.sources.files import only_listed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_out(spark):
    assert by_rows(spark.range(0, 1000, 1, 1), 300).rdd.getNumPartitions() == 4
    assert by_rows(spark.range(0), 300).count() == 0


def test_segments_without_a_shuffle_of_the_rows(spark):
    times = [0, 0, 1, 2, 2, 2, 3, 3600, 3601, 3601, 7200, 90000, 90001, None, -5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = balanced_segments(df, "ts", rows=3)
    joins = re.findall("BroadcastHashJoin|SortMergeJoin", _plan(out))
    assert joins[0] == "BroadcastHashJoin"  # the rows; the others join counts
    got = {r.id: r._bal for r in out.collect()}
    key = [-2**62 if t is None else t for t in times]
    days = [k // 86_400 for k in key]
    want = {i: (sum(d < days[i] for d in days) + sum(days[j] == days[i] and k < key[i] for j, k in enumerate(key))) // 3
            for i in range(len(key))}
    assert got == want


def test_pairs_are_counted_in_the_row(spark):
    lists = [["b", "a", "b", "c"], ["a", "a", "a"], ["x"], [], [None, "a", None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>")
    got = {r.i: {tuple(p.pair): p.m for p in r.c or []} for r in df.select("i", B._counted(B._pair_list(F.col("t"))).alias("c")).collect()}
    low = lambda p: tuple(sorted(p, key=lambda v: (v is None, v or "")))
    assert got == {i: dict(Counter(map(low, combinations(x, 2)))) for i, x in enumerate(lists)}


def test_statistics_are_broadcast_to_their_series(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE 'a' END AS k", "CAST(id % 100 AS double) AS v")
    out = S.modified_z_scores(df, "v", ["k"])
    assert "SortMergeJoin" not in _plan(out) and out.count() == 2000


def test_listing_is_broadcast(spark):
    lines = spark.createDataFrame([("file:/x/a", "1"), ("file:///x/b", "2"), ("/x/a", "3")], "path string, value string")
    out = only_listed(lines, lines.where("value = '1'").select("path"))
    assert "BroadcastHashJoin" in _plan(out) and sorted(r.value for r in out.collect()) == ["1", "3"]
