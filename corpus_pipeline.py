"""The corpus pipeline: documents in, a deduplicated training mix out.

``STAGES`` lists five ``(name, function)`` stages.  Each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet under the shared checkpoint folder and gives it, read again, to the next
stage.  Every stage sees all rows its predecessor kept; all but the last return
the columns of the input, and the last adds each row's place in the mix.

Edge cases: null or empty texts are scored, deduplicated and mixed like others;
rows repeated as a whole leave the exact deduplication as one row; a null id is
kept as any other, and rows that share an id are decided one by one; an empty table passes through; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsleuth.llm import decontaminate, exact_dedup, mixing, quality, simhash
from logsleuth.llm.common import scratch, stage
from logsleuth.llm.suite import BLOCK_ROWS, WEIGHTS
from logsleuth.tables import table


def _semi(docs: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Null-safe semi or anti join on columns of the same names."""
    prefix = _fresh(docs, "_k")
    other = keys.select(*[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(on)])
    cond = None
    for i, c in enumerate(on):
        one = docs[c].eqNullSafe(other[f"{prefix}{i}"])
        cond = one if cond is None else cond & one
    return docs.join(other, cond, how)


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken or any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


BIT_ROWS = 1 << 15  # rows of a file that one bitmap marks, 4 kB
BITMAPS = 1 << 14  # bitmaps that are broadcast at most, 64 MB


def _without_places(rows: DataFrame, mark: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose place ``mark`` (file, row) is in ``gone`` (same columns).

    A place is a bit: a row per place, its path repeated, takes many times the memory
    that Spark reads from the size of its file.
    """
    part, k = f"row div {BIT_ROWS}", _fresh(rows, "_k")
    # dealt out before the aggregation, else each task sends a bitmap of each file
    bits = stage(gone.select("file", F.expr(part).alias("part"), F.expr(f"row % {BIT_ROWS}").alias("bit"))
                     .repartition("file", "part").groupBy("file", "part")
                     .agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), "exact-dropped")
    small = bits.count() <= BITMAPS
    bits = bits.select(*[F.col(c).alias(f"{k}_{c}") for c in bits.columns]).hint("broadcast" if small else "merge")
    both = rows.join(bits, (F.col(f"{mark}.file") == F.col(f"{k}_file"))
                     & (F.expr(f"{mark}.{part}") == F.col(f"{k}_part")), "left")
    byte = f"conv(hex(substring({k}_bits, cast({mark}.row % {BIT_ROWS} div 8 AS int) + 1, 1)), 16, 10)"
    return both.where(f"coalesce(getbit(cast({byte} AS int), cast({mark}.row % 8 AS int)), 0) = 0").select(*rows.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    prefix = _fresh(docs, "_llm_")
    scored = quality.score(docs, model, keep=tuple(docs.columns), prefix=prefix)
    return scored.where(F.col(f"{prefix}predicted") == 1).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    mark = _fresh(docs, "_llm_place")
    rows = exact_dedup.located(docs, mark)
    dropped = exact_dedup.exact_dedup(rows).where("not kept").select("locator.file", "locator.row")
    # the places of dropped rows move, not texts
    return _without_places(rows, mark, dropped).select(*docs.columns)


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a key per row, written once so that it stays, and its name."""
    row = _fresh(docs, "_llm_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each near-duplicate group, null ids last."""
    rows, row = _keyed(docs, "simhash-keyed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id",
                     F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    groups = simhash.near_duplicates(rows.select(order.alias("_llm_order"), "text"), "_llm_order", shingle=3, max_bits=3)
    kept = groups.where("_llm_order = component_id").select(F.col("_llm_order.row").alias(row))
    return _semi(rows, kept, [row]).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    rows, row = _keyed(docs, "decontaminate-keyed")
    found = decontaminate.overlaps(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    found = stage(found.select(row).distinct(), "contaminated")
    return _semi(rows, found, [row], "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, files in training order."""
    return mixing.mixed_in_order(mixing.mix(docs, WEIGHTS, rest_weight=1, block_rows=BLOCK_ROWS))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("mix_sources", mix_stage),
]

# The classifier is a fitted model, which SQL cannot express; the tests compare
# the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for i, (name, fn) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
