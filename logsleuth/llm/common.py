"""Shared helpers: column defaults, staged tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: the
    result survives lost executors and is not recomputed by later readers."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col="text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


ARROW_ROWS = 1000


def for_arrow(docs: DataFrame, *cols) -> DataFrame:
    """``docs.select(*cols)`` for a function over Arrow batches.  A batch is a
    number of rows whatever their length, so with long texts it must be few: the
    session's batch size is lowered to ``ARROW_ROWS`` where it is larger."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return docs.select(*cols)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table.

    Returns ``(node, root)`` with ``root`` the smallest node of the component,
    one row per node that has a link.  Each round hooks every root to the
    smallest root seen over its links and then jumps pointers, so rounds grow
    with the logarithm of the longest chain; each round is a few equality joins
    on narrow tables, written to the shared checkpoint folder.  Hot nodes are
    aggregated before the shuffle by the partial minimum.
    """
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                       .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                       .distinct(), "cc-edges")
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = stage(both.groupBy(F.col("u").alias("node"))
                      .agg(F.min("v").alias("m"))
                      .select("node", F.least("node", "m").alias("root")), "cc-label")
    while True:
        # links between current roots; those inside one tree are done
        lu = label.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        lv = label.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = stage(edges.join(lu, "u").join(lv, "v").where("ru <> rv")
                           .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
                           .distinct(), "cc-edges")
        # pointer jumping of trees whose root got a smaller parent
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        if edges.isEmpty():
            nxt = stage(label.join(jump, "root", "left")
                             .select("node", F.coalesce("up", "root").alias("root"),
                                     (F.coalesce("up", "root") != F.col("root")).alias("moved")), "cc-label")
            label = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                return label
            continue
        hook = edges.groupBy(F.col("v").alias("root")).agg(F.min("u").alias("h"))
        label = stage(label.join(jump, "root", "left").join(hook, "root", "left")
                           .select("node", F.least(F.coalesce("up", "root"), F.coalesce("h", "root"))
                                            .alias("root")), "cc-label")
        # hooked roots must themselves be nodes with a label; they are, as every
        # root is a node of some link.  Links between old roots stay valid since
        # a root keeps its own label row.
