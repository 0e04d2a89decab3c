"""Robust z-scores on numeric series (whole-series and rolling).

A series is a set of rows sharing the ``by`` columns; the row order only
matters for the rolling variant.  Three scoring presets differ on purpose:

=====================  ========  ===========  ===========  ==============
preset                 compare   sign         MAD = 0      std kind
=====================  ========  ===========  ===========  ==============
detect_anomalies_mod_z ``>=``    absolute     std fallback population
detect_anomalies       ``>``     absolute     std fallback population
statistical_anomalies  abs ``>`` signed       score 0      sample (std z)
=====================  ========  ===========  ===========  ==============

A group holding a NULL or NaN value scores NULL and flags nothing (the array
library the semantics come from turns NULL into NaN, and a NaN median makes
every score NaN).  Scores are rounded to 1e-9 before threshold comparisons so
that an exact fallback value such as 2.0 compares equal to a threshold 2.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.keys import join_on
from . import rolling
from ..session import as_table, cut_lineage
from ..plans.quantiles import exact_median, median_col_from_sorted_array
from ..plans.ranking import balanced_segments, ordinal_segment, row_index

# Fixed value: consistency constant of the modified z-score.
MODIFIED_Z_CONST = 0.6745
CMP_DIGITS = 9
# Windows above this many rows slide over ordered values instead of sorting each.
WIDE_WINDOW = 64
WIDE_CHUNK_ROWS = 131_072


def series_stats(df: DataFrame, value: str = "value", by=()) -> DataFrame:
    """Per-series n, median, MAD, mean, population and sample std, and a
    ``poisoned`` flag when the series holds NULL or NaN (A1, A2).

    Two exact median passes (value, then |value - median|) built from
    partial-aggregated histograms (see :mod:`logsleuth.plans.quantiles`), so a
    hot series is never gathered in one task; moments are plain partial
    aggregates.
    """
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("_x"))
    moments = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("_x").isNull() | F.isnan("_x"), 1).otherwise(0)).alias("_bad"),
        F.avg("_x").alias("mean"),
        F.stddev_pop("_x").alias("std_pop"),
        F.stddev_samp("_x").alias("std_samp"),
    )
    # the statistics are one row per series: as tables of known size they are
    # broadcast to the rows, or joined by a shuffle when the series are many; left
    # as a plan of joins their size is unknown, and all rows of a series would be
    # sorted in one task
    med = as_table(exact_median(base, by, "_x", "median"), "series-medians")
    dev = join_on(base, med, by).select(*by, F.abs(F.col("_x") - F.col("median")).alias("_d"))
    mad = exact_median(dev, by, "_d", "mad")
    stats = as_table(join_on(join_on(moments, med, by, "left"), mad, by, "left"), "series-stats")
    return stats.withColumn("poisoned", F.col("_bad") == 1).drop("_bad")


def _robust_abs_score(x, med, mad, mean, std):
    """|0.6745 (x - med) / MAD|, else |x - mean| / std_pop, else 0."""
    return (F.when(mad != 0, F.abs(F.lit(MODIFIED_Z_CONST) * (x - med) / mad))
             .when(std != 0, F.abs((x - mean) / std))
             .otherwise(F.lit(0.0)))


def modified_z_scores(df: DataFrame, value: str = "value", by=(),
                      score_col: str = "score") -> DataFrame:
    """W2 scores: absolute modified z with the population-std fallback."""
    by = list(by)
    stats = series_stats(df, value, by)
    out = join_on(df, stats.select(*by, "median", "mad", "mean", "std_pop", "poisoned"), by)
    x = F.col(value).cast("double")
    score = _robust_abs_score(x, F.col("median"), F.col("mad"), F.col("mean"), F.col("std_pop"))
    out = out.withColumn(score_col, F.when(~F.col("poisoned"), score))
    return out.drop("median", "mad", "mean", "std_pop", "poisoned")


def _flag(score_col: str, threshold: float, strict: bool):
    s = F.round(F.col(score_col), CMP_DIGITS)
    cond = s > F.lit(threshold) if strict else s >= F.lit(threshold)
    return F.coalesce(cond, F.lit(False))


def detect_anomalies_mod_z(df: DataFrame, value: str = "value", by=(), threshold: float = 3.5,
                           score_col: str = "score", flag_col: str = "is_anomaly") -> DataFrame:
    """Flag ``score >= threshold`` (default 3.5)."""
    out = modified_z_scores(df, value, by, score_col)
    return out.withColumn(flag_col, _flag(score_col, threshold, strict=False))


def detect_anomalies(df: DataFrame, value: str = "value", by=(), threshold: float = 3.0,
                     score_col: str = "score", flag_col: str = "anomaly") -> DataFrame:
    """Flag ``score > threshold`` (default 3.0); same scores as W2."""
    out = modified_z_scores(df, value, by, score_col)
    return out.withColumn(flag_col, _flag(score_col, threshold, strict=True))


def statistical_anomalies(df: DataFrame, value: str = "value", by=(), threshold: float = 2.5,
                          use_modified_zscore: bool = True, score_col: str = "score",
                          flag_col: str = "is_anomaly") -> DataFrame:
    """Signed modified (or standard, sample-std) z; ``abs(score) > t``;
    series with fewer than 3 values flag nothing; MAD = 0 or std = 0 → 0."""
    by = list(by)
    stats = series_stats(df, value, by)
    out = join_on(df, stats.select(*by, "n", "median", "mad", "mean", "std_samp", "poisoned"), by)
    x = F.col(value).cast("double")
    if use_modified_zscore:
        score = F.when(F.col("mad") == 0, F.lit(0.0)).otherwise(
            F.lit(MODIFIED_Z_CONST) * (x - F.col("median")) / F.col("mad"))
    else:
        score = F.when(F.col("std_samp") == 0, F.lit(0.0)).otherwise(
            (x - F.col("mean")) / F.col("std_samp"))
    out = out.withColumn(score_col, F.when(~F.col("poisoned"), score))
    flag = (F.col("n") >= 3) & (F.round(F.abs(F.col(score_col)), CMP_DIGITS) > F.lit(threshold))
    out = out.withColumn(flag_col, F.coalesce(flag, F.lit(False)))
    return out.drop("n", "median", "mad", "mean", "std_samp", "poisoned")


def anomalous_indices_with_scores(df: DataFrame, value: str = "value", by=(),
                                  threshold: float = 3.5, score_col: str = "score") -> DataFrame:
    """PF9: only the rows whose W2 score is ``>= threshold`` (NaN/NULL never)."""
    out = modified_z_scores(df, value, by, score_col)
    return out.where(_flag(score_col, threshold, strict=False))


def recommend_reconciliation(flagged: DataFrame, flag_col: str = "is_anomaly",
                             action_col: str = "action") -> DataFrame:
    """PF10: each flagged row gets the action ``investigate_and_tag``."""
    return flagged.where(F.col(flag_col)).withColumn(action_col, F.lit("investigate_and_tag"))


# ---------------------------------------------------------------- rolling

_array_median = median_col_from_sorted_array


def _window_score(vals, x):
    """Score of ``x`` against the window ``vals`` (W2 rules, population std)."""
    med = _array_median(vals)
    mad = _array_median(F.transform(vals, lambda v: F.abs(v - med)))
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v) / n
    var = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / n
    std = F.sqrt(var)
    poisoned = F.exists(vals, lambda v: F.isnan(v))
    return F.when(~poisoned, _robust_abs_score(x, med, mad, mean, std))


def windowed_modified_z_scores(df: DataFrame, value: str = "value", by=(), order=("ord",),
                               window_size: int = 5, score_col: str = "score",
                               chunk_rows: int = 1_000_000, segment=None,
                               segment_ts: str | None = None) -> DataFrame:
    """Centred rolling modified z over rows ``i - w//2 .. i + w//2`` (cut at
    the ends; an even ``w`` behaves as ``w + 1``).  ``order`` must be a total
    order inside each series.

    A series is cut into chunks of ``chunk_rows`` consecutive rows (positions
    from :func:`row_index`), each chunk gets ``w//2`` halo rows copied from
    its neighbours, the window runs per (series, chunk), and halos are
    dropped: one long series never lands in one task.  ``segment`` is an
    order-preserving bucket of the order columns used to number rows (see
    :mod:`logsleuth.plans.ranking`); default: blocks of the first ordinal, or,
    with ``segment_ts`` (a timestamp that leads the order), segments that follow
    the number of rows.

    Windows of more than ``WIDE_WINDOW`` rows slide over ordered values, one Arrow
    chunk at a time (see :mod:`logsleuth.operators.rolling`): about log w per row
    where sorting every window costs w log w.
    """
    if window_size < 1:
        raise ValueError("window_size must be >= 1")
    by, order = list(by), list(order)
    h = window_size // 2
    wide = 2 * h + 1 > WIDE_WINDOW
    c = max(min(int(chunk_rows), WIDE_CHUNK_ROWS) if wide else int(chunk_rows), 2 * h + 1)
    x = F.col(value).cast("double")
    src = df.withColumn("_x", F.when(x.isNull(), F.lit(float("nan"))).otherwise(x))
    if segment_ts is not None:
        src = cut_lineage(balanced_segments(src, segment_ts))
        segment = F.col("_bal")
    elif segment is None:
        segment = ordinal_segment(order[0])
    src = row_index(src, by, order, segment, name="_pos").drop("_bal")
    own = F.floor(F.col("_pos") / c)
    r = F.col("_pos") % c
    copies = F.array(
        F.struct(own.alias("_chunk"), F.lit(True).alias("_own")),
        F.when(r < h, F.struct((own - 1).alias("_chunk"), F.lit(False).alias("_own"))),
        F.when(r >= c - h, F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_own"))),
    )
    exp = src.withColumn("_cp", F.explode(F.array_compact(copies))).select("*", "_cp.*").drop("_cp")
    if wide:
        kept = exp.drop("_x", "_pos", "_chunk", "_own", score_col)
        schema = StructType([*kept.schema.fields, StructField(score_col, DoubleType())])
        return exp.groupBy(*by, "_chunk").applyInArrow(
            rolling.score_chunk(h, score_col, MODIFIED_Z_CONST, kept.columns), schema)
    w = Window.partitionBy(*by, "_chunk").orderBy("_pos").rowsBetween(-h, h)
    out = exp.withColumn("_vals", F.collect_list("_x").over(w)).where(F.col("_own"))
    out = out.withColumn(score_col, _window_score(F.col("_vals"), F.col("_x")))
    return out.drop("_x", "_pos", "_chunk", "_own", "_vals")
