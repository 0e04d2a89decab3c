"""Single-column CSV in, ``value,anomaly`` CSV out (SC9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import detect_anomalies


def read_single_column_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV with exactly one column → ``ord, value DOUBLE``.
    More than one column is an error.  ``ord`` is the line position (file
    order is kept by the source's file offsets)."""
    df = spark.read.csv(path, header=False)
    if len(df.columns) > 1:
        raise ValueError("CSV must contain a single numeric column")
    pos = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                   F.monotonically_increasing_id())
    df = df.select(F.col("_c0").cast("double").alias("value"), pos.alias("_pos"))
    return df


def score_csv(spark: SparkSession, path: str, threshold: float = 3.0) -> DataFrame:
    """W2b over the whole column: ``value, anomaly``."""
    df = read_single_column_csv(spark, path).withColumn("_k", F.lit(0))
    out = detect_anomalies(df, "value", ["_k"], threshold=threshold, flag_col="anomaly")
    return out.select("_pos", "value", "anomaly")


def write_scored_csv(scored: DataFrame, path: str) -> None:
    (scored.orderBy("_pos").select("value", "anomaly")
           .write.mode("overwrite").option("header", True).csv(path))

