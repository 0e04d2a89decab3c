"""Join helpers.

Joins against data-derived side tables are plain equi-joins: AQE turns them
into broadcast joins only when the materialised side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (a runtime size check),
and keeps a shuffle join otherwise.  ``F.broadcast`` is used only for
literal dimension tables whose size is fixed by code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys``; the right copies of the keys are dropped."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    ren = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(ren[c]) if c in ren else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(r[ren[k]]) for k in keys])
    out = left.join(r, cond, how)
    return out.select(*[c for c in out.columns if c not in ren.values()])


def attach_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row statistics table to every row (broadcast of one row)."""
    return df.crossJoin(F.broadcast(one_row))
