"""Filter interaction audit by min-plus removal ranks.

Which filter removes a text depends on the order of the filters.  A text's
failures are a row of the mask matrix (zero where it fails, infinite where it
passes) and an order's inverse permutation a column of the position matrix (the
step at which each filter runs).  Their min-plus product is the step that removes
the text under that order: the least position among the filters it fails.

``audit`` counts texts per part and mask first, one partial aggregation over the
table, so what follows has at most 32 masks a part: each mask's removal step under
every order (a least over positions, null standing for infinite) drives weighted
counts per order and step: removed here, removed earlier though failing here
(redundant), still kept, and the wanted and unwanted texts lost.  ``shapley`` is a
filter's removals summed over all orders.

``document_failures`` gives the five filters of ``FILTERS``, and copies are found
by a 256-bit digest of the text: the smallest id of each digest, joined back.

Edge cases: a null text counts as empty, which fails A and, beside a smaller id
with an empty text, E; long texts are read whole; a null part is the empty string;
several label rows of one id count once, as wanted (or unwanted) if any says so; a
null id has no label and counts as larger than any id, so only a copy with an id
makes it a copy; rows repeated as a whole share an id and are no copies of one
another; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\x0c\r"


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """``id_col``, the columns ``keep`` and one boolean per filter of ``FILTERS``:
    A under 100 words; B fewer than 80 % distinct words; C more than 10 % capital
    letters A to Z; D one of ``#$%&*|``; E the text of a smaller id."""
    text = F.col("_audit_text")
    docs = docs.select(F.col(id_col).alias("_audit_id"), *[F.col(c).alias(f"_audit_{i}") for i, c in enumerate(keep)],
                       text_or_empty(text_col).alias("_audit_text"))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.split(bare, r"[ \t\n\x0B\f\r]+")
    n = F.when(bare == "", 0).otherwise(F.size(words)).cast("long")
    different = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    each = docs.select("_audit_id", *[f"_audit_{i}" for i in range(len(keep))],
                       F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("_audit_digest"),
                       (n < 100).alias("A"), (different * 100 < n * 80).alias("B"),
                       (capitals * 100 > F.length(text).cast("long") * 10).alias("C"),
                       text.rlike(r"[#$%&*|]").alias("D"))
    # digests of several rows, with the smallest id; single ones need no join
    first = (each.groupBy("_audit_digest").agg(F.min("_audit_id").alias("_audit_least"), F.count(F.lit(1)).alias("_n"))
                 .where("_n > 1").drop("_n"))
    copy = F.col("_audit_least").isNotNull() & (F.col("_audit_id").isNull() | (F.col("_audit_id") > F.col("_audit_least")))
    return each.join(first, "_audit_digest", "left").select(
        F.col("_audit_id").alias(id_col), *[F.col(f"_audit_{i}").alias(c) for i, c in enumerate(keep)],
        *FILTERS[:4], copy.alias("E"))


def removal_step(filters: str):
    """Min-plus product of one mask row and one position column: the least step
    among the failed filters, null if none fails."""
    return F.least(*[F.when(F.col(f), F.col(f"order.at_{f}")) for f in filters])


def audit(failures: DataFrame, part, wanted, unwanted, filters: str = FILTERS) -> DataFrame:
    """Counts per ``part``, order of the filters and step, zeros included.
    ``failures`` has one boolean column per filter; ``wanted`` and ``unwanted``
    are boolean columns."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    masks = failures.groupBy(part.alias("part"), *filters).agg(
        F.count(F.lit(1)).alias("n"), count(wanted).alias("good"), count(unwanted).alias("toxic"))
    orders = F.array(*[F.struct(F.lit("".join(p)).alias("name"), *[F.lit(p.index(f) + 1).alias(f"at_{f}") for f in filters])
                       for p in permutations(filters)])
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    rows = (masks.withColumn("order", F.explode(orders)).withColumn("at", removal_step(filters))
                 .withColumn("step", F.explode(steps)))
    fails = [F.col(f).cast("int") for f in filters]
    here = F.substring("order.name", F.col("step"), F.lit(1))
    failing = F.coalesce(*[F.when(here == f, F.col(f)) for f in filters])
    total = lambda cond, of="n": F.sum(F.when(cond, F.col(of)).otherwise(0)).cast("long")
    removed = F.col("at") == F.col("step")
    out = rows.groupBy("part", F.col("order.name").alias("filter_order"), "step").agg(
        total(F.col("at").isNull() | (F.col("at") > F.col("step"))).alias("kept"),
        total(removed).alias("removed"),
        total(failing & (F.col("at") < F.col("step"))).alias("redundant"),
        total(failing & (sum(fails[1:], fails[0]) == 1)).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))
    name = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", name)))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_col: str = "lang") -> DataFrame:
    """:func:`audit` of the five document filters with the ``quality`` and
    ``toxic`` marks of ``labels``."""
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.bool_or(F.col("quality") == 1).alias("_good"), F.bool_or(F.col("toxic") == 1).alias("_toxic"))
    failures = document_failures(docs, id_col, text_col, keep=(part_col,))
    failures = failures.join(marks, F.col(id_col) == F.col("_id"), "left")
    return audit(failures, F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.col("_good"), F.col("_toxic"))
