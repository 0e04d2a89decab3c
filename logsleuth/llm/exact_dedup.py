"""Exact deduplication as a stateful stream.

Each row is reduced to a narrow record: the SHA-256 of its normalised text, its
stable identifier, its length in code points and a content locator (file and row
number in that file, as the file source gives them).  The records run through a
Structured Streaming aggregation keyed by the digest.  State is held in RocksDB
on local disk and checkpointed to the shared folder, has no watermark and so no
expiry, and keeps for every digest the identifier and locator of the row that
stays and the number of rows seen.  The aggregation combines rows of one key
before the shuffle, so a key that holds a third of the rows is one record per
task.

Only digests that were hit more than once are checked on full bytes: the smallest
and the largest normalised text of the digest must be equal.  Should two texts
ever share a digest, their rows leave the stream's answer and are grouped by
the text itself.

With a durable ``root`` a later call continues the state of the earlier ones: its
rows are judged against all rows seen so far, and texts of earlier calls that
its rows hit are read again from their locators.  Calls on one root run one after
the other; a call that failed is repeated under the same ``batch`` before the next
one, which counts its rows once.  Files that a locator names must stay: a missing
or changed row is an error.

Edge cases: null text counts as empty and all empty texts form one group; texts of
any length are one record and are never cut; ties in length go to the smallest id
(nulls last), then to the row seen first; rows repeated as a whole count one by
one and exactly one of them stays; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WHITE = " \t\n\x0b\x0c\r"


def normalised(col) -> Column:
    """The text without the six ASCII white-space characters."""
    return F.translate(col, WHITE, "")


def sha256_hex(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def located(docs: DataFrame, name: str = "locator", content: str | None = None) -> DataFrame:
    """``docs`` with the place of each row, ``name`` = (file, row).

    Rows of Parquet files have one already.  Other rows are written first, to
    ``content`` or a staged folder.  A plan that multiplies the rows of its files
    (``explode``) should be written by the caller.
    """
    def place(df):
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias(name))
    try:
        return place(docs)
    except AnalysisException:  # no file source, or one without row numbers
        if content is None:
            return place(stage(docs, "located"))
        docs.write.mode("overwrite").parquet(content)
        return place(docs.sparkSession.read.schema(docs.schema).parquet(content))


def _written(spark, path: str) -> bool:
    """A finished write left its mark in ``path``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _smallest() -> Column:
    return F.min(F.struct("rank", F.col("id").isNull().alias("no_id"), "id", "call", "seq", "locator"))


def _is_kept() -> Column:
    return (F.col("call") == F.col("keep.call")) & (F.col("seq") == F.col("keep.seq"))


def dedup_state(records: DataFrame, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over the record files under ``root``/records (``records`` gives
    their schema) and return the last state of each digest:
    ``(digest, group_size, keep)``.

    The checkpoint and the per-batch output live under ``root``; running it
    again after more record files arrived continues from the kept state.  The
    stream has a session of its own, so the caller's settings stay as they are.
    """
    spark = records.sparkSession
    side = spark.newSession()
    side.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    side.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # many small stores: no space laid aside on disk for each of their logs
    side.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    reader = side.readStream.schema(records.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    state = (reader.parquet(f"{root}/records/*").groupBy("digest")
                   .agg(F.count(F.lit(1)).alias("group_size"), _smallest().alias("keep")))

    def keep_batch(batch, batch_id):
        # a repeated batch overwrites its own folder: exactly-once output
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    (state.writeStream.outputMode("update").foreachBatch(keep_batch)
          .option("checkpointLocation", f"{root}/checkpoint")
          .trigger(availableNow=True).start().awaitTermination())
    schema = state.schema.add("batch", "long")
    seen = spark.read.schema(schema).option("basePath", f"{root}/state").parquet(f"{root}/state")
    return (seen.groupBy("digest").agg(F.max_by(F.struct("group_size", "keep"), "batch").alias("s"))
                .select("digest", "s.group_size", "s.keep"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_files_per_trigger: int | None = None, digest=sha256_hex,
                root: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``digest`` and ``locator``.  ``max_files_per_trigger`` bounds a micro-batch by
    files of records; ``digest`` may be replaced (tests use a weak one).  ``root`` is
    a shared folder whose state this call continues, ``batch`` the name of the call
    in it; without them the call stands alone."""
    spark = docs.sparkSession
    root = (root or scratch(spark, "exact-dedup")).rstrip("/")
    batch = batch or f"{time.time_ns():020d}"
    path = f"{root}/records/{batch}"
    repeated = _written(spark, path)
    content = f"{root}/content/{batch}"
    narrow = docs.select(id_col, text_col)
    if repeated and _written(spark, content):
        narrow = spark.read.schema(narrow.schema).parquet(content)
    text = text_or_empty(text_col)
    rows = located(narrow, "locator", content).select(
        F.col(id_col).alias("id"), normalised(text).alias("norm"), (-F.length(text)).alias("rank"), "locator"
    ).withColumn("digest", digest(F.col("norm")))
    if not repeated:
        (rows.select("digest", "id", "rank", "locator", F.lit(batch).alias("call"),
                     F.monotonically_increasing_id().alias("seq"))
             .write.mode("overwrite").parquet(path))
    schema = f"digest string, id {docs.schema[id_col].dataType.simpleString()}, rank int, " \
             "locator struct<file:string, row:bigint>, call string, seq bigint"
    records = spark.read.schema(schema).parquet(path)
    if records.isEmpty():
        return records.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"),
                              F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"),
                              "digest", "locator")
    state = dedup_state(records, root, max_files_per_trigger)
    earlier = spark.read.schema(schema).parquet(f"{root}/records/*").where(F.col("call") != batch)
    alone = earlier.isEmpty()
    if not alone:
        state = state.join(records.select("digest").distinct(), "digest", "left_semi")
    state = stage(state, "exact-dedup-state")

    # full bytes on hits: smallest and largest text of the digest, combined
    # before the shuffle, must be the same
    hits = state.where("group_size > 1").select("digest")
    texts = rows.join(hits, "digest", "left_semi").select("digest", "norm")
    if not alone:
        first = (earlier.join(hits, "digest", "left_semi").groupBy("digest")
                        .agg(F.min(F.struct("call", "seq", "locator")).alias("f")).select("digest", "f.locator"))
        texts = texts.unionByName(_fetch(stage(first, "exact-dedup-earlier"), text_col, digest).select("digest", "norm"))
    (texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
          .where("lo <> hi").select("digest").write.mode("overwrite").parquet(f"{root}/collided/{batch}"))
    collided = spark.read.schema("digest string").parquet(f"{root}/collided/*").distinct()
    out = records.join(state, "digest").select(
        "id", "digest", "locator", "group_size", F.col("keep.id").alias("keep_id"), _is_kept().alias("kept"))
    if not collided.isEmpty():
        mine = rows.join(collided, "digest", "left_semi").select(
            "*", F.lit(batch).alias("call"), F.monotonically_increasing_id().alias("seq"))
        old = None if alone else _fetch(stage(earlier.join(collided, "digest", "left_semi"), "exact-dedup-old"),
                                        text_col, digest)
        out = out.join(collided, "digest", "left_anti").unionByName(_by_text(mine, old, batch))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest", "locator")


def _fetch(wanted: DataFrame, text_col: str, digest) -> DataFrame:
    """``wanted`` (digest, locator, ...) with ``norm`` read from the located rows."""
    spark = wanted.sparkSession
    # names of files, as many as their reader lists on the driver anyway
    files = [unquote(r["file"]) for r in wanted.select("locator.file").distinct().collect()]
    if not files:
        return wanted.withColumn("norm", F.lit(""))
    texts = located(spark.read.schema(f"`{text_col}` string").parquet(*files)).select(
        "locator", normalised(text_or_empty(text_col)).alias("norm"))
    same = digest(F.col("norm")) == F.col("digest")
    return wanted.join(texts, "locator", "left").withColumn(
        "norm", F.when(same, F.col("norm")).otherwise(
            F.raise_error(F.concat(F.lit("text of an earlier row is missing or changed: "), F.to_json("locator")))))


def _by_text(mine: DataFrame, old: DataFrame | None, batch: str) -> DataFrame:
    """The rows of collided digests, grouped by the normalised text; rows of earlier
    calls count and may stay, but are not returned."""
    cols = ["id", "rank", "digest", "norm", "locator", "call", "seq"]
    every = mine.select(*cols) if old is None else mine.select(*cols).unionByName(old.select(*cols))
    every = stage(every, "exact-dedup-collided")
    best = every.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), _smallest().alias("keep"))
    return every.where(F.col("call") == batch).join(best, "norm").select(
        "id", "digest", "locator", "group_size", F.col("keep.id").alias("keep_id"), _is_kept().alias("kept"))
