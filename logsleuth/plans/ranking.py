"""Skew-safe positional primitives.

``row_index`` gives every row its 0-based position inside its key group under
a total order, and optionally the group size, without a
``Window.partitionBy(key)`` over the whole group: such a window sends a whole
group to one task, and one hot key (a shared NAT address, a service role)
can hold a third of all rows.

Plan: an order-preserving *segment* of the order columns (a run of seconds that
holds a bounded number of rows, see :func:`balanced_segments`, or a block of an
ordinal) cuts each group into pieces.  A window runs
per (key, segment) for the local row number; a block table — one row per
(key, segment) with its row count, much smaller than the data — is
prefix-summed per key, and its offsets are joined back (AQE broadcasts the
block table when its runtime size allows, else a shuffle join on the same
(key, segment) hash partitioning the window already produced).

Everything is deterministic: no sampling, no partition-id arithmetic, so task
retries recompute identical positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_on

HOUR_US = 3_600_000_000


def time_segment(ts_col: str, seconds: int = 3600) -> Column:
    """Order-preserving segment of a timestamp: whole ``seconds`` since epoch."""
    c = F.col(ts_col)
    micros = F.unix_micros(c.cast("timestamp"))
    return F.floor(micros / F.lit(seconds * 1_000_000))


def ordinal_segment(col: str, width: int = 1_000_000) -> Column:
    """Order-preserving segment of a numeric ordinal."""
    return F.floor(F.col(col) / F.lit(width))


def row_index(df: DataFrame, keys, order, segment: Column, name: str = "_rn",
              size_name: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank of the row inside ``keys`` under ``order``.

    ``segment`` must be non-decreasing in ``order`` (see :func:`time_segment`).
    ``order`` must be a total order inside a key for positions to be unique.
    ``size_name`` adds the group size.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    seg = df.withColumn("_seg", segment)
    local = seg.select("*", (F.row_number().over(
        Window.partitionBy(*keys, "_seg").orderBy(*order)) - 1).alias("_lrn"))
    blocks = seg.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_seg") if keys else Window.orderBy("_seg")
    blocks = blocks.withColumn(
        "_off",
        F.coalesce(F.sum("_bn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_name:
        wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
        blocks = blocks.withColumn(size_name, F.sum("_bn").over(wk))
    out = join_on(local, blocks.drop("_bn"), keys + ["_seg"])
    keep = [c for c in out.columns if c not in ("_seg", "_lrn", "_off")]
    return out.select(*keep, (F.col("_off") + F.col("_lrn")).alias(name))


def balanced_segments(df: DataFrame, ts_col: str, name: str = "_bal", rows: int = 1_000_000) -> DataFrame:
    """Add ``name``: an order-preserving segment of a timestamp that follows the
    data.  Rows are counted per second, seconds are numbered by the running count
    over days and inside each day, and a segment is a run of seconds of about
    ``rows`` rows (a second is never cut).  No calendar unit with many rows ends
    in one task, and sparse times share a segment; counting is exact, so retries
    give the same segments."""
    unit = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / F.lit(1_000_000))
    x = df.withColumn("_unit", F.coalesce(unit, F.lit(-2**62)))
    hist = x.groupBy("_unit").agg(F.count(F.lit(1)).alias("_c")).withColumn("_day", F.floor(F.col("_unit") / 86_400))
    days = hist.groupBy("_day").agg(F.sum("_c").alias("_dc"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_dc").over(earlier), F.lit(0)).alias("_doff"))
    run = Window.partitionBy("_day").orderBy("_unit")
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bounds = hist.join(days, "_day").select(
        "_day", "_unit", F.floor((F.col("_before") + F.col("_doff")) / F.lit(rows)).cast("long").alias("_sg"))
    # rows look up their segment in a table of one row per hour, which holds the
    # seconds where a segment begins: at most the hours of the calendar and one entry
    # per segment, so it is broadcast and the rows are not shuffled
    hour = F.floor(F.col("_unit") / 3_600)
    by_hour = Window.partitionBy("_hour").orderBy("_unit")
    bounds = bounds.withColumn("_hour", hour).withColumn("_prev", F.lag("_sg").over(by_hour))
    starts = (bounds.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_sg"))).groupBy("_hour")
                    .agg(F.sort_array(F.collect_list(F.struct("_unit", "_sg"))).alias("_starts")))
    out = x.withColumn("_hour", hour).join(F.broadcast(starts), "_hour")
    first = F.col("_starts")[0]["_sg"]
    found = F.element_at(F.filter("_starts", lambda s: s["_unit"] <= F.col("_unit")), -1)["_sg"]
    return out.withColumn(name, F.when(F.size("_starts") == 1, first).otherwise(found)).drop("_unit", "_hour", "_starts")


def running_totals(df: DataFrame, keys, order, segment: Column, weights: dict, inclusive: bool = True) -> DataFrame:
    """Running sums of ``weights`` (name -> column) per key under a total
    ``order`` (inclusive of the current row unless ``inclusive=False``), same
    two-level plan as :func:`row_index`: a local window per (key, segment) and a
    prefix over blocks, once for all sums."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    names = list(weights)
    w, loc, off = ([f"_{p}{i}" for i in range(len(names))] for p in ("w", "l", "o"))
    seg = df.select("*", segment.alias("_seg"), *[weights[n].cast("long").alias(c) for n, c in zip(names, w)])
    frame = (Window.partitionBy(*keys, "_seg").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = seg.select("*", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(x) for c, x in zip(w, loc)])
    blocks = seg.groupBy(*keys, "_seg").agg(*[F.sum(c).alias(c) for c in w])
    by = Window.partitionBy(*keys).orderBy("_seg") if keys else Window.orderBy("_seg")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_seg", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in zip(w, off)])
    out = join_on(local, blocks, keys + ["_seg"])
    keep = [c for c in out.columns if c not in ("_seg", *w, *loc, *off)]
    return out.select(*keep, *[(F.col(o) + F.col(x)).alias(n) for n, o, x in zip(names, off, loc)])


def running_total(df: DataFrame, keys, order, segment: Column, weight: Column, name: str,
                  inclusive: bool = True) -> DataFrame:
    """One running sum, see :func:`running_totals`."""
    return running_totals(df, keys, order, segment, {name: weight}, inclusive)


def running_count(df: DataFrame, keys, order, segment: Column, name: str) -> DataFrame:
    """Inclusive running count of rows per key under a total ``order``."""
    return running_total(df, keys, order, segment, F.lit(1), name)
