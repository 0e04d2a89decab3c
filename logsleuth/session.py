"""Session construction and cluster-safe settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library relies on.
_REQUIRED_CONF = {
    # Event hours / weekdays are computed in UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce tiny shuffles, split skewed partitions,
    # and turn size-checked joins into broadcasts from real shuffle stats.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Bounded status history: a long-lived driver running many large plans
# should not keep every finished execution in memory.
_DRIVER_CONF = {
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
}


def get_spark(master: str | None = None, app: str = "logsleuth",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's required settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if (master or "").startswith("local"):  # a cluster's own settings stay as they are
        builder = (builder.config("spark.ui.enabled", "false")
                          .config("spark.ui.showConsoleProgress", "false")
                          .config("spark.driver.memory", os.environ.get("LOGSLEUTH_DRIVER_MEMORY", "16g")))
    for k, v in {**_DRIVER_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    and Spark runs in one local process (tests) a private folder is created and
    registered; on a cluster a folder of one machine would lose data, so an
    unset folder is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.sparkContext.master
    if not re.match(r"local($|\[)", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    local = tempfile.mkdtemp(prefix="logsleuth-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def as_table(df, name: str):
    """``df`` written once as parquet under the shared checkpoint folder and read
    back: lineage is cut as by :func:`cut_lineage`, the copy is compressed and its
    columns are read singly, and the planner knows its size, so a small table is
    broadcast without a shuffle of the other side."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
