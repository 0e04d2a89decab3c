"""Tasks that follow the number of rows.

A scan makes its tasks from bytes.  A table of short rows is few bytes, so work that
costs much per row, or turns a row into many, would run on all its rows in a few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_TASK = 20_000


def by_rows(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt out evenly over tasks of about ``rows`` rows."""
    return df.repartition(max(1, -(-df.count() // rows)))
