"""Exact per-group medians without collecting a group into one task.

``percentile``/``median`` aggregates buffer every distinct value of a group in
one task; a hot series would not fit.  Instead:

1. every value gets an order-preserving bucket (sign, binary exponent and the
   top 12 mantissa bits), and ``groupBy(key, bucket).count()`` — a partial
   aggregate, so a hot key is pre-combined on every executor — gives a
   histogram per key;
2. a prefix sum over the (small) histogram finds the bucket holding each
   middle rank and the rank's offset inside it;
3. only rows of those one or two buckets per key are kept and split again
   linearly between the bucket's own min and max into 2**20 parts; a prefix
   sum over that second histogram narrows to one part, whose distinct values
   (at most 2**20, duplicates pre-aggregated) give the exact value.

Three scans, no global sort, no sampling; results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import as_table
from .keys import join_on

_MANTISSA_BUCKETS = 4096
_EXP_BIAS = 1100


def value_bucket(v: Column) -> Column:
    """Monotone non-decreasing long bucket of a double (NaN above all).

    The exponent is held at the largest double's (its logarithm rounds up to the
    next one), powers of two down to the smallest subnormal are exact, and the
    infinities have buckets of their own.
    """
    a = F.abs(v)
    e = F.least(F.floor(F.log2(a)), F.lit(1023))
    mag = ((e + F.lit(_EXP_BIAS)) * F.lit(_MANTISSA_BUCKETS) + F.floor(
        a / F.pow(F.lit(2.0), e) * F.lit(_MANTISSA_BUCKETS))).cast("long")
    return (F.when(F.isnan(v), F.lit(2**62))
             .when(v == F.lit(float("inf")), F.lit(2**61))
             .when(v == F.lit(float("-inf")), F.lit(-2**61))
             .when(v == 0, F.lit(0))
             .when(v > 0, mag)
             .otherwise(-mag))


def _locate(hist: DataFrame, part_keys, order_col: str, ranks: DataFrame, rank_col: str) -> DataFrame:
    """Prefix-sum ``hist`` (one row per bucket with ``_c``) within
    ``part_keys`` in ``order_col`` order and keep, for every wanted rank of
    ``ranks``, the bucket holding it and the rank inside that bucket."""
    w = Window.partitionBy(*part_keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.sum("_c").over(w)).withColumn("_before", F.col("_cum") - F.col("_c"))
    # without keys the ranks are a handful of rows (two per quantile)
    j = join_on(h, ranks, part_keys) if part_keys else h.crossJoin(F.broadcast(ranks))
    return (j.where((F.col("_before") <= F.col(rank_col)) & (F.col(rank_col) < F.col("_cum")))
             .withColumn(rank_col, F.col(rank_col) - F.col("_before"))
             .drop("_cum", "_before", "_c"))


# 2**12 buckets per exponent and 2**20 linear parts of a bucket leave at most
# 2**20 distinct doubles of 52 mantissa bits in a part: a bounded last step.
SUB_BUCKETS = 1 << 20


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """One row per key with exact linearly interpolated quantiles of non-null
    ``value``: ``probs`` maps output column -> probability in [0, 1].

    Quantile p sits at 0-based position p (n - 1); its two neighbouring order
    statistics are located in three narrowing steps, each a partial
    aggregate (a hot key is pre-combined on every executor):

    1. (key, bucket) counts, min and max with the order-preserving bucket;
    2. inside each wanted bucket, (key, bucket, sub-bucket) counts with a
       linear split of the bucket's own [min, max] into 2**20 parts (a bucket
       whose min equals its max is resolved right away);
    3. inside each wanted sub-bucket, the distinct values with their counts.

    Interpolation is ``lo + (hi - lo) * frac`` (the median as ``(lo + hi) / 2``).
    """
    keys = list(keys)
    base = (df.select(*keys, F.col(value).cast("double").alias("_v"))
              .where(F.col("_v").isNotNull())
              .withColumn("_b", value_bucket(F.col("_v"))))
    hist = base.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"),
                                         F.max("_v").alias("_bmax"))
    n = hist.groupBy(*keys).agg(F.sum("_c").alias("_n")).where(F.col("_n") > 0)
    specs = []
    for qi, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            specs.append(F.struct(F.lit(f"{qi}_{side}").alias("_t"), rank.cast("long").alias("_r"),
                                  (pos - F.floor(pos)).alias("_frac")))
    ranks = n.select(*keys, F.explode(F.array(*specs)).alias("_s")).select(*keys, "_s.*")
    # one row per key and rank: as a table of known size it is broadcast below, or
    # joined by a shuffle when the keys are many
    t1 = as_table(_locate(hist, keys, "_b", ranks, "_r"), "quantile-buckets")  # keys, _b, _bmin, _bmax, _t, _r, _frac
    done1 = t1.where(F.col("_bmin") == F.col("_bmax")).select(*keys, "_t", "_frac",
                                                            F.col("_bmin").alias("_val"))
    open1 = t1.where(F.col("_bmin") < F.col("_bmax"))
    span = F.col("_bmax") - F.col("_bmin")
    sub = F.least(F.floor((F.col("_v") - F.col("_bmin")) / span * SUB_BUCKETS),
                  F.lit(SUB_BUCKETS - 1)).cast("long")
    wanted = open1.select(*keys, "_b", "_bmin", "_bmax").distinct()
    rows2 = join_on(base, wanted, keys + ["_b"]).withColumn("_sb", sub)
    hist2 = rows2.groupBy(*keys, "_b", "_sb").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_smin"),
                                                  F.max("_v").alias("_smax"))
    t2 = as_table(_locate(hist2, keys + ["_b"], "_sb", open1.drop("_bmin", "_bmax"), "_r"), "quantile-parts")
    done2 = t2.where(F.col("_smin") == F.col("_smax")).select(*keys, "_t", "_frac",
                                                            F.col("_smin").alias("_val"))
    open2 = t2.where(F.col("_smin") < F.col("_smax"))
    rows3 = join_on(rows2, open2.select(*keys, "_b", "_sb").distinct(), keys + ["_b", "_sb"])
    dist = rows3.groupBy(*keys, "_b", "_sb", "_v").agg(F.count(F.lit(1)).alias("_c"))
    t3 = _locate(dist, keys + ["_b", "_sb"], "_v", open2.drop("_smin", "_smax"), "_r")
    done3 = t3.select(*keys, "_t", "_frac", F.col("_v").alias("_val"))
    picked = done1.unionByName(done2).unionByName(done3)
    aggs = []
    for qi, (name, p) in enumerate(probs.items()):
        lo = F.max(F.when(F.col("_t") == f"{qi}_lo", F.col("_val")))
        hi = F.max(F.when(F.col("_t") == f"{qi}_hi", F.col("_val")))
        frac = F.max(F.when(F.col("_t") == f"{qi}_lo", F.col("_frac")))
        if float(p) == 0.5:
            aggs.append(F.when(frac == 0, lo).otherwise((lo + hi) / 2).alias(name))
        else:
            aggs.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return picked.groupBy(*keys).agg(*aggs)


def exact_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    """One row per key with the interpolating median of non-null ``value``.

    Even counts average the two middle values ((a + b) / 2, as numpy does).
    NaN ranks above every number, as in Spark and numpy.
    """
    return exact_quantiles(df, keys, value, {name: 0.5})


def median_col_from_sorted_array(arr: Column) -> Column:
    """Median of a (bounded) array column, numpy rules."""
    s = F.array_sort(arr)
    n = F.size(s)
    a = F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1)
    b = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return (a + b) / 2
