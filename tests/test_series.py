import math

import pytest
from pyspark.sql import functions as F

from logsleuth.operators import series as S


def _series(spark, values, key="s"):
    rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, ord long, value double")


def _ordered(df, col):
    return [r[col] for r in df.orderBy("ord").collect()]


def test_detect_strict_outlier(spark):
    out = S.detect_anomalies(_series(spark, [1.0, 1.1, 0.9, 5.0]), by=["series_key"], threshold=2.0)
    assert _ordered(out, "anomaly") == [False, False, False, True]


def test_constant_series_no_flags(spark):
    out = S.detect_anomalies(_series(spark, [2, 2, 2]), by=["series_key"])
    assert _ordered(out, "anomaly") == [False] * 3


def test_fallback_z_below_threshold(spark):
    out = S.detect_anomalies(_series(spark, [1, 1, 1, 10]), by=["series_key"], threshold=2.0)
    assert _ordered(out, "anomaly") == [False] * 4
    assert _ordered(out, "score")[-1] == pytest.approx(1.7320508, abs=1e-6)


def test_only_last_flagged(spark):
    out = S.detect_anomalies(_series(spark, [10, 10, 10, 10, 1000]), by=["series_key"], threshold=1.9)
    assert _ordered(out, "anomaly") == [False] * 4 + [True]


def test_mod_z_scores_hand_values(spark):
    out = S.modified_z_scores(_series(spark, [10, 12, 11, 13, 100]), by=["series_key"])
    got = _ordered(out, "score")
    assert got == pytest.approx([1.349, 0.0, 0.6745, 0.6745, 59.3560], abs=1e-3)
    assert max(got) == got[-1]


def test_mod_z_constant_zero(spark):
    out = S.detect_anomalies_mod_z(_series(spark, [5] * 5), by=["series_key"])
    assert _ordered(out, "score") == [0.0] * 5
    assert not any(_ordered(out, "is_anomaly"))


def test_mod_z_fallback_equality(spark):
    df = _series(spark, [1, 1, 1, 1, 50])
    out = S.detect_anomalies_mod_z(df, by=["series_key"], threshold=2.0)
    assert _ordered(out, "is_anomaly") == [False] * 4 + [True]
    hits = S.anomalous_indices_with_scores(df, by=["series_key"], threshold=2.0)
    rec = S.recommend_reconciliation(hits.withColumn("is_anomaly", F.lit(True)))
    assert [(r.ord, r.action) for r in rec.collect()] == [(4, "investigate_and_tag")]


def test_rolling_window(spark):
    out = S.windowed_modified_z_scores(_series(spark, [1, 1, 100, 1, 1]), by=["series_key"],
                                       order=["ord"], window_size=3)
    got = _ordered(out, "score")
    assert got == pytest.approx([0.0, 0.7071068, 1.4142136, 0.7071068, 0.0], abs=1e-6)
    assert got.index(max(got)) == 2


def test_rolling_chunks_equal_plain(spark):
    vals = [((i * 37) % 11) + (50 if i % 17 == 0 else 0) for i in range(120)]
    df = _series(spark, vals)
    a = _ordered(S.windowed_modified_z_scores(df, by=["series_key"], order=["ord"], window_size=5), "score")
    b = _ordered(S.windowed_modified_z_scores(df, by=["series_key"], order=["ord"], window_size=5,
                                              chunk_rows=7,
                                              segment=F.floor(F.col("ord") / 10)), "score")
    assert a == pytest.approx(b)


def test_rolling_wide_equals_sorting_each_window(spark, monkeypatch):
    """Ordered sliding windows against the window expression, over chunk borders,
    with ties, gaps, infinities and a constant stretch."""
    import random
    rng = random.Random(5)
    vals = [rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), 7.0]) for _ in range(300)] + [2.5] * 100
    vals[150], vals[220], vals[221] = None, float("inf"), float("-inf")
    df = _series(spark, vals)
    args = {"by": ["series_key"], "order": ["ord"], "window_size": 21}
    plain = _ordered(S.windowed_modified_z_scores(df, **args), "score")
    monkeypatch.setattr(S, "WIDE_WINDOW", 4)
    wide = _ordered(S.windowed_modified_z_scores(df, chunk_rows=50, **args), "score")
    assert len(wide) == 400 and sum(v is None for v in wide) == 21
    for a, b in zip(plain, wide):
        assert a == b or (a is None) == (b is None) and (a != a and b != b or abs(a - b) < 1e-9)


def test_kth_deviation_is_the_sorted_one():
    import random
    from logsleuth.operators.rolling import kth_deviation
    rng = random.Random(3)
    for _ in range(500):
        vals = sorted(rng.randrange(12) / 2 for _ in range(rng.randrange(1, 14)))
        m = rng.choice([vals[0], vals[-1], rng.random() * 6])
        dev = sorted(abs(v - m) for v in vals)
        assert [kth_deviation(vals, m, k) for k in range(len(vals))] == dev


def test_rolling_window_size_error(spark):
    with pytest.raises(ValueError):
        S.windowed_modified_z_scores(_series(spark, [1, 2]), by=["series_key"], window_size=0)


def test_statistical_standard(spark):
    out = S.statistical_anomalies(_series(spark, [1, 2, 3, 100]), by=["series_key"], threshold=1.0,
                                  use_modified_zscore=False)
    flagged = [r.ord for r in out.where("is_anomaly").orderBy("ord").collect()]
    assert flagged[0] == 3
    assert _ordered(out, "score")[-1] == pytest.approx(1.4998, abs=1e-4)


@pytest.mark.parametrize("vals", [[1, 2], []])
def test_statistical_too_short(spark, vals):
    out = S.statistical_anomalies(_series(spark, vals), by=["series_key"], threshold=0.1)
    assert out.where("is_anomaly").count() == 0


def test_nan_or_null_poisons_group(spark):
    out = S.detect_anomalies_mod_z(_series(spark, [1, 1, None, 1, 50]), by=["series_key"], threshold=1.0)
    assert not any(_ordered(out, "is_anomaly"))
    out = S.detect_anomalies_mod_z(_series(spark, [1, float("nan"), 1, 50]), by=["series_key"], threshold=1.0)
    assert not any(_ordered(out, "is_anomaly"))


def test_exact_median_matches_python(spark):
    import statistics
    from logsleuth.plans.quantiles import exact_median
    vals = [((i * 7919) % 1000) / 7.0 - 40 for i in range(501)] + [0.0, -0.0, 3.0, 3.0, 1e-300, -1e300]
    for n in (len(vals), len(vals) - 1):
        df = _series(spark, vals[:n])
        got = exact_median(df, ["series_key"], "value").collect()[0]["median"]
        assert got == pytest.approx(statistics.median(vals[:n]), rel=1e-12)


def test_row_index_positions(spark):
    from logsleuth.plans.ranking import row_index
    rows = [("a" if i % 3 else "b", i, (i * 13) % 40) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, t long")
    out = row_index(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5), size_name="n")
    got = {(r.k, r.id): (r._rn, r.n) for r in out.collect()}
    for k in ("a", "b"):
        sub = sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1]))
        for pos, r in enumerate(sub):
            assert got[(k, r[1])] == (pos, len(sub))


def test_exact_quantiles_concentrated_values(spark):
    import numpy as np
    from logsleuth.plans.quantiles import exact_quantiles
    # most values packed into a tiny range inside one bucket, plus spread outliers and duplicates
    vals = [1000.0 + i * 1e-9 for i in range(300)] + [1000.2, 5.0, -3.5, 0.0, 1000.0, 1000.0] + \
           [float(i) for i in range(50)]
    df = spark.createDataFrame([("k", v) for v in vals] + [("j", 2.0)] * 5, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p10": 0.1}).collect()}
    a = np.array(vals)
    assert got["k"].p50 == np.median(a)
    assert got["k"].p95 == pytest.approx(np.percentile(a, 95), rel=1e-12)
    assert got["k"].p10 == pytest.approx(np.percentile(a, 10), rel=1e-12)
    assert got["j"].p50 == 2.0
    g = exact_quantiles(df.where("k = 'k'"), [], "v", {"p99": 0.99}).collect()[0]
    assert g.p99 == pytest.approx(np.percentile(a, 99), rel=1e-12)
