"""File listing and whole-file reads (SC1, SC2, SC6–SC8).

Listing uses the ``binaryFile`` source with only its metadata columns
selected, so file contents are never read.  Whole-file text comes from
``spark.read.text(wholetext=True)``; Hadoop picks the gzip codec from the
``.gz`` extension, and ``_metadata`` gives the path and on-disk size.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import as_table
from .records import fits_whole


def list_log_files(spark: SparkSession, root: str, prefix: str = "",
                   start_date: datetime | None = None, end_date: datetime | None = None,
                   max_files: int | None = None, recursive: bool = True) -> DataFrame:
    """SC1: files under ``root`` whose path (relative to root) starts with
    ``prefix``, modified within the inclusive range, folder markers dropped,
    first ``max_files`` in listing (path) order."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    # the date range goes to the listing too, a second wider on either side, in
    # the session's time zone; the exact inclusive test follows below
    if start_date is not None:
        reader = reader.option("modifiedAfter", (start_date - timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S"))
    if end_date is not None:
        reader = reader.option("modifiedBefore", (end_date + timedelta(seconds=2)).strftime("%Y-%m-%dT%H:%M:%S"))
    # whole folders of the prefix narrow the folder that is listed
    folder = prefix.rpartition("/")[0]
    df = (reader.load(f"{root.rstrip('/')}/{folder}" if folder else root)
                .select("path", "modificationTime", "length"))
    root_uri = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*" + re.escape(root_uri.lstrip("/")) + "/?", "")
    df = df.withColumn("key", rel)
    if prefix:
        df = df.where(F.col("key").startswith(prefix))
    if start_date is not None:
        df = df.where(F.col("modificationTime") >= F.lit(start_date))
    if end_date is not None:
        df = df.where(F.col("modificationTime") <= F.lit(end_date))
    df = df.where(~F.col("key").endswith("/")).orderBy("key")
    if max_files is not None:
        df = df.limit(max_files)
    return df.select("path", "key", F.col("modificationTime").alias("last_modified"),
                     F.col("length").alias("size"))


def _reader(spark: SparkSession, recursive: bool):
    return spark.read.option("recursiveFileLookup", str(recursive).lower())


def _fits(whole_bytes):
    return fits_whole(F.col("_metadata.file_path"), F.col("_metadata.file_size"), whole_bytes)


def read_whole_files(spark: SparkSession, paths, recursive: bool = False, whole_bytes: int | None = None) -> DataFrame:
    """SC2: one row per file: ``path``, decompressed UTF-8 ``value``,
    ``file_size`` on disk; with ``whole_bytes`` only the files up to that size
    (others are not opened)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _reader(spark, recursive).text(paths, wholetext=True)
    df = df if whole_bytes is None else df.where(_fits(whole_bytes))
    return df.select(F.col("_metadata.file_path").alias("path"), "value",
                     F.col("_metadata.file_size").alias("file_size"))


def large_files(spark: SparkSession, paths, recursive: bool, whole_bytes: int) -> DataFrame:
    """``path`` of the files above ``whole_bytes``, from the listing alone."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _reader(spark, recursive).format("binaryFile").load(paths).select("path", "length")
    return df.where(~fits_whole(F.col("path"), F.col("length"), whole_bytes)).select("path")


def only_listed(df: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of files (``path``) that a listing names.  The listing stays a
    DataFrame; no list of paths goes through the driver.  It is broadcast up to
    ``BROADCAST_PATHS`` paths: a join by path would send all lines of a file to one
    task."""
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    keys = as_table(listing.select(bare(F.col("path")).alias("_key")).distinct(), "listing")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_PATHS else keys
    return df.withColumn("_key", bare(F.col("path"))).join(keys, "_key", "left_semi").drop("_key")


BROADCAST_PATHS = 1_000_000


def read_listed(spark: SparkSession, root: str, listing: DataFrame, wholetext: bool = True) -> DataFrame:
    """SC2 for a listing (:func:`list_log_files`) of any length: the files under
    ``root`` whose path is listed, as :func:`read_whole_files` or, with
    ``wholetext=False``, as lines."""
    df = _reader(spark, True).text(root, wholetext=wholetext)
    df = df.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_size").alias("file_size"))
    return only_listed(df, listing)


def read_lines(spark: SparkSession, paths, recursive: bool = False, whole_bytes: int | None = None) -> DataFrame:
    """Line-oriented read for large (splittable) flow logs: ``path, value``; with
    ``whole_bytes`` only the files above that size, with their ``file_size``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _reader(spark, recursive).text(paths)
    if whole_bytes is None:
        return df.select(F.col("_metadata.file_path").alias("path"), "value")
    return df.where(~_fits(whole_bytes)).select(F.col("_metadata.file_path").alias("path"), "value",
                                                F.col("_metadata.file_size").alias("file_size"))


def file_stem(path_col) -> F.Column:
    """File name without directories and without the last extension."""
    name = F.regexp_extract(path_col, r"([^/]+)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")
