"""Analyst reports over scored events (PF12–PF15, A11–A16, A21, A25, A26,
SL1–SL3, SL5, J11, J14).

Input: the per-event table of :func:`behavior.aggregate_scores` with
``event_id, ts, user, action, source_ip, region, aggregate_score,
anomaly_scores`` (array of score structs in detector order).

Global statistics are one-row aggregates (partial aggregation), exact
percentiles use the histogram plan of :mod:`logsleuth.plans.quantiles`, and
per-key context counts are ``groupBy`` + join, not windows over a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hof import explode_rows
from ..plans.keys import attach_global
from ..session import cut_lineage
from ..plans.quantiles import exact_quantiles
from ..plans.ranking import balanced_segments, row_index, running_totals
from ..session import cut_lineage

# Threshold sweep 1.0, 1.5, ..., 9.5 and the target rate.
SWEEP_THRESHOLDS = [1.0 + 0.5 * i for i in range(18)]
TARGET_RATE = 0.02


def flag_anomalous(scored: DataFrame, threshold: float) -> DataFrame:
    """PF12: boolean split by ``aggregate_score >= threshold``."""
    return scored.withColumn("is_anomalous", F.col("aggregate_score") >= F.lit(float(threshold)))


def _anomalous_factors(scores):
    hits = F.filter(scores, lambda s: s["is_anomaly"])
    return hits, F.flatten(F.transform(hits, lambda s: s["factors"]))


def anomaly_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """A25 (+ SL5): one row per anomalous event with the best flagged score,
    the number of flagged factors, the first three joined by '; ' (or
    'Unknown'), hour and day name."""
    hits, facs = _anomalous_factors(F.col("anomaly_scores"))
    an = scored.where(F.col("aggregate_score") >= F.lit(float(threshold)))
    return an.select(
        "event_id", "ts", "user", "action", "source_ip", "region", "aggregate_score",
        F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(hits, lambda s: s["score"])),
                                          F.lit(0.0))).alias("max_individual_score"),
        F.size(facs).alias("num_anomaly_factors"),
        F.when(F.size(facs) > 0, F.concat_ws("; ", F.slice(facs, 1, 3))).otherwise("Unknown")
         .alias("factors"),
        F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("day_of_week"))


def round_like_pandas(c, digits: int = 2):
    """``DataFrame.round``: rint(x * 10^d) / 10^d on the binary value
    (Spark's ``round``/``bround`` work on the decimal string instead).
    Summation order makes a mean differ in its last bits between engines,
    so that noise is removed first (round to 1e-9)."""
    scale = float(10 ** digits)
    return F.rint(F.round(c, 9) * scale) / scale


def anomalies_by(summary: DataFrame, col: str) -> DataFrame:
    """Anomalies per ``col`` with count and mean score rounded to 2."""
    return summary.groupBy(col).agg(F.count(F.lit(1)).alias("count"),
                                    round_like_pandas(F.avg("aggregate_score"), 2).alias("avg_score"))


def top_counts(summary: DataFrame, col: str, k: int = 10) -> DataFrame:
    """SL2/SL3: the ``k`` most frequent values (ties by value)."""
    return (summary.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
                   .orderBy(F.desc("count"), F.asc(col)).limit(k))


def top_anomalies(summary: DataFrame, k: int = 10) -> DataFrame:
    """SL1: highest aggregate scores; ties keep the earliest event."""
    return summary.orderBy(F.desc("aggregate_score"), F.asc("ts"), F.asc("event_id")).limit(k)


def mode_of(summary: DataFrame, col: str) -> DataFrame:
    """Most frequent value (smallest value on ties)."""
    c = summary.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min_by(col, F.struct((-F.col("n")).alias("n"), F.col(col).alias("v"))).alias(col))


def summary_stats(summary: DataFrame) -> DataFrame:
    """Mean, median, max aggregate score of the anomalies."""
    summary = cut_lineage(summary.select("aggregate_score"))
    mean_max = summary.agg(F.avg("aggregate_score").alias("mean_score"),
                           F.max("aggregate_score").alias("max_score"))
    med = exact_quantiles(summary, [], "aggregate_score", {"median_score": 0.5})
    return mean_max.crossJoin(med)


def score_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of aggregate scores between min and max,
    last bin closed (numpy rules; a constant column spans value ± 0.5)."""
    rng = scored.agg(F.min("aggregate_score").alias("_lo"), F.max("aggregate_score").alias("_hi"))
    rng = (rng.withColumn("_l", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")))
              .withColumn("_h", F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))))
    x = attach_global(scored.select("aggregate_score"), rng.select("_l", "_h"))
    width = (F.col("_h") - F.col("_l")) / bins
    b = F.least(F.floor((F.col("aggregate_score") - F.col("_l")) / width), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_l", "_h")
    out = edges.join(counts, "bin", "left")
    w = (F.col("_h") - F.col("_l")) / bins
    return out.select("bin", (F.col("_l") + F.col("bin") * w).alias("bin_start"),
                      (F.col("_l") + (F.col("bin") + 1) * w).alias("bin_end"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def detection_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row of distribution metrics and the quality verdicts."""
    t = F.lit(float(threshold))
    # the scores come from a deep pipeline and feed several aggregates:
    # materialise the one-column projection once (shared checkpoint folder)
    scored = cut_lineage(scored.select("aggregate_score"))
    base = scored.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("aggregate_score") >= t).alias("detected_anomalies"),
        F.avg("aggregate_score").alias("mean_score"),
        F.stddev_pop("aggregate_score").alias("std_score"),
        F.max("aggregate_score").alias("max_score"),
        F.min("aggregate_score").alias("min_score"),
        F.count_if(F.col("aggregate_score") >= t).alias("scores_above_threshold"))
    q = exact_quantiles(scored, [], "aggregate_score", {
        "median_score": 0.5, "score_95th_percentile": 0.95, "score_99th_percentile": 0.99})
    out = base.crossJoin(q).withColumn("detection_rate",
                                       F.col("detected_anomalies") / F.col("total_events"))
    rate = F.col("detection_rate")
    return (out.withColumn("rate_verdict", F.when(rate > 0.10, "raise_threshold")
                           .when(rate < 0.01, "lower_threshold").otherwise("well_calibrated"))
               .withColumn("variance_verdict", F.when(F.col("std_score") < 1.0, "low_variance")
                           .otherwise("good_variance")))


def threshold_sweep(scored: DataFrame, thresholds=None) -> DataFrame:
    """A14 (+ J11): count, rate and mean score for each threshold, from ONE
    scan with a conditional count per threshold (the thresholds are a fixed
    literal list, so no cross join of the events is needed)."""
    ts = SWEEP_THRESHOLDS if thresholds is None else list(thresholds)
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg("aggregate_score").alias("avg_score")]
    aggs += [F.count_if(F.col("aggregate_score") >= F.lit(float(t))).alias(f"_c{i}")
             for i, t in enumerate(ts)]
    one = scored.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_c{i}").alias("anomaly_count"))
                     for i, t in enumerate(ts)])
    out = one.select("_n", "avg_score", F.explode(rows).alias("r")).select("r.*", "_n", "avg_score")
    return out.select("threshold", "anomaly_count",
                      (F.col("anomaly_count") / F.col("_n")).alias("anomaly_rate"), "avg_score")


def recommend_threshold(sweep: DataFrame, target_rate: float = TARGET_RATE,
                        current: float = 5.0) -> DataFrame:
    """Threshold whose rate is closest to ``target_rate`` (lowest on
    ties) and the rate/count at the threshold closest to ``current``."""
    rec = sweep.agg(
        F.min_by("threshold", F.struct(F.abs(F.col("anomaly_rate") - target_rate), F.col("threshold")))
         .alias("recommended_threshold"),
        F.min_by("anomaly_rate", F.struct(F.abs(F.col("anomaly_rate") - target_rate), F.col("threshold")))
         .alias("recommended_rate"),
        F.min_by("anomaly_rate", F.struct(F.abs(F.col("threshold") - current), F.col("threshold")))
         .alias("current_rate"),
        F.min_by("anomaly_count", F.struct(F.abs(F.col("threshold") - current), F.col("threshold")))
         .alias("current_count"))
    return rec


def running_anomaly_rate(scored: DataFrame, every: int = 100,
                         segment_rows: int = 1_000_000) -> DataFrame:
    """After every ``every`` events (in (ts, event_id) order), the
    running share of events with any flagged score and the number of
    distinct entity profiles seen so far.  Positions and running sums use the
    segmented prefix plans (no single-partition window)."""
    flag = F.coalesce(F.exists("anomaly_scores", lambda s: s["is_anomaly"]), F.lit(False))
    ev = scored.select("event_id", "ts", flag.alias("_f"), "entities")
    ents = explode_rows(ev, "entities", "e", keep=["event_id", "ts"]).select(
        "event_id", "ts", "e.entity_type", "e.entity_id")
    first = ents.groupBy("entity_type", "entity_id").agg(
        F.min(F.struct("ts", "event_id")).alias("m")).select("m.*")
    new_per_event = first.groupBy("event_id").agg(F.count(F.lit(1)).alias("_new"))
    ev = ev.join(new_per_event, "event_id", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    ev = cut_lineage(balanced_segments(ev.drop("entities"), "ts", rows=segment_rows))
    ev = running_totals(ev, [], ["ts", "event_id"], F.col("_bal"), {
        "processed_events": F.lit(1), "_anom": F.col("_f").cast("int"), "total_profiles": F.col("_new")})
    return ev.where(F.col("processed_events") % every == 0).select(
        "processed_events", (F.col("_anom") / F.col("processed_events")).alias("anomaly_rate"),
        "total_profiles")


def investigation_context(summary: DataFrame) -> DataFrame:
    """PF13, PF14, J14: calendar flags, priority band and how many anomalies
    share the user and the action (aggregate + join, skew-safe)."""
    by_user = summary.groupBy("user").agg(F.count(F.lit(1)).alias("user_anomalies"))
    by_action = summary.groupBy("action").agg(F.count(F.lit(1)).alias("action_anomalies"))
    h = F.hour("ts")
    s = F.col("aggregate_score")
    return (summary.join(by_user, "user", "left").join(by_action, "action", "left")
                   .withColumn("off_hours", (h < 6) | (h > 20))
                   .withColumn("business_hours", (h >= 8) & (h <= 18))
                   .withColumn("is_weekend", F.weekday("ts") >= 5)
                   .withColumn("priority", F.when(s > 8.0, "HIGH").when(s > 6.0, "MEDIUM")
                               .otherwise("LOW")))


def analyst_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """PF15: flatten each anomalous event to the 17-column analyst row."""
    an = scored.where(F.col("aggregate_score") >= F.lit(float(threshold)))
    ind = F.transform("anomaly_scores", lambda s: s["score"])
    facs = F.flatten(F.transform("anomaly_scores", lambda s: s["factors"]))
    idx = row_index(cut_lineage(balanced_segments(an, "ts")), [], ["ts", "event_id"], F.col("_bal"), name="_i")
    return idx.select(
        (F.col("_i") + 1).alias("anomaly_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("user_arn"), F.col("user").alias("user_name"), F.col("action").alias("event_name"),
        "source_ip", F.col("region").alias("aws_region"), "user_agent", "aggregate_score",
        F.coalesce(F.array_max(ind), F.lit(0.0)).alias("max_individual_score"),
        F.size(facs).alias("num_scoring_factors"),
        F.concat_ws("; ", facs).alias("scoring_factors"),
        F.concat_ws("; ", F.transform("entities", lambda e: F.concat_ws(
            ":", e["entity_type"], e["entity_id"]))).alias("entities_detected"),
        F.hour("ts").alias("hour_of_day"), F.weekday("ts").alias("day_of_week"),
        (F.weekday("ts") >= 5).alias("is_weekend"),
        ((F.hour("ts") >= 8) & (F.hour("ts") <= 18)).alias("is_business_hours"))


def latest_datapoint(history: DataFrame, keys, ts_col: str = "ts", value_col: str = "value") -> DataFrame:
    """SL8: the latest value per key (``max_by``, a partial aggregate)."""
    keys = list(keys)
    return history.groupBy(*keys).agg(F.max_by(value_col, ts_col).alias(value_col),
                                      F.max(ts_col).alias(ts_col))


def export_analysis(summary: DataFrame, detailed: DataFrame, metrics: DataFrame, out_dir: str,
                    config: dict | None = None) -> None:
    """SC16: summary CSV, detailed CSV, and metrics (+ config) as JSON."""
    summary.write.mode("overwrite").option("header", True).csv(f"{out_dir}/anomaly_summary")
    detailed.write.mode("overwrite").option("header", True).csv(f"{out_dir}/detailed_anomalies")
    m = metrics
    for k, v in (config or {}).items():
        m = m.withColumn(f"config_{k}", F.lit(v))
    m.write.mode("overwrite").json(f"{out_dir}/metrics")
