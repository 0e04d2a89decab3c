"""Run a streaming plan over the files available now and read its output.

Output and checkpoint folders are created under the session's shared
checkpoint location (``spark.checkpoint.dir``; a private folder only when
unset, as in tests), so a restarted driver resumes from the same progress.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet",
                 glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """File source over a folder with an explicit schema (no inference on
    streams); ``glob`` selects the file names the stream picks up."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The RocksDB state store for streams started inside; a started stream keeps
    it, the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process everything available with an ``availableNow`` trigger into a
    parquet sink and return the sink as a batch DataFrame."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    with rocksdb_state(spark):
        q = (stream.writeStream.format("parquet").outputMode(output_mode)
                   .option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk")
                   .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def run_updates_now(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process everything available in update mode and return the last row of
    each key: the state of an aggregate after all input, open windows included.

    Every micro-batch overwrites a folder of its own, so a repeated batch does
    not add rows."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(keep)
               .option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = stream.schema.add("batch", "long")
    rows = spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    rest = [c for c in stream.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
                .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


ROWS_PER_FILE = 200_000


def write_batches(parts: list[DataFrame], name: str, rows_per_file: int = ROWS_PER_FILE) -> tuple[str, int]:
    """Write ``parts`` one after the other as files of about ``rows_per_file`` rows,
    the same number of files for each, and return the folder and that number: a file
    stream reads the oldest files first, so with ``maxFilesPerTrigger`` of that
    number each micro-batch is one part, whatever its size.  Parts without rows are
    left out."""
    spark = parts[0].sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    counts = [p.count() for p in parts]
    some = [n for n in counts if n]
    files = max(1, min([-(-max(some) // rows_per_file), *some])) if some else 1
    if not some:
        parts[0].write.parquet(root)
    written = 0
    for part, n in zip(parts, counts):
        if n:
            part.repartition(files).write.mode("append").parquet(root)
            written += files
    if some and len(spark.read.schema(parts[0].schema).parquet(root).inputFiles()) != written:
        raise RuntimeError(f"a part of {root} has not {files} files")
    return root, files


def time_ordered_files(df: DataFrame, ts_col: str, name: str, parts: int = 3) -> tuple[str, int]:
    """:func:`write_batches` of ``parts`` consecutive time ranges, so that the
    micro-batches follow event time; rows without a time go with the first."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    span = df.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // parts + 1)
    number = F.coalesce(F.floor((us - F.lit(span["a"] or 0)) / F.lit(width)), F.lit(0))
    return write_batches([df.where(number == i) for i in range(parts)], name)
