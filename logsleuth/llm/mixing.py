"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in a fixed pseudo-random order, are cut into blocks of
``block_rows`` rows.  A source of integer weight ``w`` (``D`` the sum over the
sources that still have rows) must give its block ``j`` of a period of ``D``
slots not before slot ``floor(j*D/w)`` (release) and before slot
``ceil((j+1)*D/w)`` (deadline).  Serving, slot by slot, the released block with
the earliest deadline meets every deadline, so after every slot each source is
less than one block away from its target share.  All sources are back in phase
after ``D`` slots, so one period, a table of ``D`` rows, is the whole schedule.

When a source has no block left, the sources that remain form a new phase with
their weights over the new sum: every row is placed exactly once and none is
dropped or repeated.  There are at most as many phases as weights.

The only data taken to the driver are the row counts of the named sources; the
schedule table has at most (sources + 1) x sum of weights rows, which bounds
the broadcast.  Row numbers come from a count per (source, hash bucket) and a
numbering inside each bucket, so a source with a third of the rows is spread
over as many tasks as it has buckets.

Edge cases: rows of a source without a weight (null included) share the weight
``rest_weight``; weights that are not positive integers are refused; repeated
rows each get their own place; ties in the order are broken by the id, then by
the row hash; an empty table gives an empty result; columns of the input keep
their names and values, and the added columns replace any of the same name.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PERIOD = 10_000  # slots; bounds the schedule table
_ADDED = ("mix_source", "block", "phase", "release", "deadline", "slot", "position")


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period under earliest deadline first: for each slot
    ``(source, block of the period, release, deadline, slot)``."""
    total = sum(weights.values())
    waiting = {s: 0 for s in weights}  # next block of each source
    by_release = [(0, s) for s in sorted(weights)]
    heapq.heapify(by_release)
    ready, out = [], []
    for slot in range(total):
        while by_release and by_release[0][0] <= slot:
            release, s = heapq.heappop(by_release)
            j = waiting[s]
            heapq.heappush(ready, (ceil(Fraction((j + 1) * total, weights[s])), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("missed deadline")
        out.append((s, j, release, deadline, slot))
        waiting[s] = j + 1
        if j + 1 < weights[s]:
            heapq.heappush(by_release, (floor(Fraction((j + 1) * total, weights[s])), s))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """The phases of a mix: weights of the sources still active, first slot,
    number of slots, and each active source's first block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = {s: 0 for s in left}
    out, start = [], 0
    while left:
        active = {s: weights[s] for s in left}
        table = period(active)
        total = len(table)
        slots = {s: [] for s in active}
        for s, _, _, _, slot in table:
            slots[s].append(slot)
        # the slot after the last block of the source that is first to run out
        end = min((n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] + 1 for s, n in left.items())
        out.append({"weights": active, "start": start, "slots": end, "first": dict(done), "table": table})
        for s in list(left):
            served = end // total * active[s] + sum(x < end % total for x in slots[s])
            done[s] += served
            left[s] -= served
            if left[s] == 0:
                del left[s]
        start += end
    return out


def mix(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, source_col: str = "source",
        id_col: str = "doc_id", block_rows: int = 64, bucket_rows: int = 500,
        seed: int = 17) -> DataFrame:
    """``docs`` with ``mix_source`` (weighted source, null: the rest), ``block``
    (of that source), ``phase``, ``release`` and ``deadline`` (first and last slot
    + 1 in which the block may run), ``slot`` and ``position`` (place of the row
    in the mix, from 0 without gaps)."""
    if any(not isinstance(w, int) or w < 1 for w in [*weights.values(), rest_weight]):
        raise ValueError("weights must be positive integers")
    if sum(weights.values()) + rest_weight > MAX_PERIOD:
        raise ValueError(f"weights must not add to more than {MAX_PERIOD}")
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in _ADDED]
    names = sorted(weights)
    # class number of each named source; the rest is the last class
    cls = F.coalesce(*[F.when(F.col(source_col) == n, F.lit(i)) for i, n in enumerate(names)],
                     F.lit(len(names)))
    w = {i: weights[n] for i, n in enumerate(names)} | {len(names): rest_weight}
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits
    tie = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if c in keep and not re.search("map<|variant", kind)])
    counts = {r["_c"]: r["n"] for r in docs.select(cls.alias("_c")).groupBy("_c")
              .agg(F.count(F.lit(1)).alias("n")).collect()}  # at most len(weights) + 1 rows
    if not counts:
        return docs.select(*keep, F.lit(None).cast("string").alias("mix_source"),
                           *[F.lit(0).cast("long").alias(c) for c in _ADDED[1:]]).limit(0)
    plan = phases({str(i): w[i] for i in counts}, {str(i): -(-n // block_rows) for i, n in counts.items()})

    # row numbers: buckets of the order hash, counted, with a running offset
    n_buckets = max(1, -(-max(counts.values()) // bucket_rows))
    bucket = F.floor(F.col("_h") / F.lit(float(1 << 60)) * n_buckets)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(id_col).alias("_id"), cls.alias("_c"),
                       order.alias("_h"), tie.alias("_t")) \
               .withColumn("_b", F.least(bucket, F.lit(n_buckets - 1)).cast("int"))
    sizes = docs.select(cls.alias("_c"), order.alias("_h")) \
                .withColumn("_b", F.least(bucket, F.lit(n_buckets - 1)).cast("int")) \
                .groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_c", "_b", (F.sum("_n").over(Window.partitionBy("_c").orderBy("_b"))
                                       - F.col("_n")).alias("_off"))
    num = F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", "_id", "_t"))
    numbered = rows.withColumn("_i", num).join(before, ["_c", "_b"]) \
                   .withColumn("_i", F.col("_i") + F.col("_off") - 1) \
                   .withColumn("block", F.floor(F.col("_i") / block_rows).cast("long"))

    # bounded tables: (phase, class) and (phase, class, block of the period)
    spans, slots = [], []
    for p, x in enumerate(plan):
        total = len(x["table"])
        for s, wt in x["weights"].items():
            served = x["slots"] // total * wt + sum(1 for e in x["table"] if e[0] == s and e[4] < x["slots"] % total)
            spans.append((p, int(s), wt, total, x["start"], x["first"][s], x["first"][s] + served))
        slots += [(p, int(s), j, r, d, t) for s, j, r, d, t in x["table"]]
    span = spark.createDataFrame(spans, "phase long, _c int, _w long, _d long, _start long, _lo long, _hi long")
    slot = spark.createDataFrame(slots, "phase long, _c int, _j long, _r long, _dl long, _s long")
    placed = (numbered.join(F.broadcast(span), "_c")
                      .where((F.col("block") >= F.col("_lo")) & (F.col("block") < F.col("_hi")))
                      .withColumn("_j", (F.col("block") - F.col("_lo")) % F.col("_w"))
                      .join(F.broadcast(slot), ["phase", "_c", "_j"]))
    base = F.col("_start") + F.floor((F.col("block") - F.col("_lo")) / F.col("_w")).cast("long") * F.col("_d")
    placed = placed.withColumns({"release": base + F.col("_r"), "deadline": base + F.col("_dl"),
                                 "slot": base + F.col("_s")})
    # last blocks may be short: the rows they lack move later slots forward
    lack = F.lit(0).cast("long")
    for s in counts:
        short = -counts[s] % block_rows
        if short:
            at = _slot_of(plan, str(s), -(-counts[s] // block_rows) - 1)
            lack = lack + F.when(F.col("slot") > at, F.lit(short)).otherwise(F.lit(0))
    name = F.element_at(F.array(*[F.lit(n) for n in names], F.lit(None).cast("string")), F.col("_c") + 1)
    return placed.withColumn("position", F.col("slot") * block_rows + F.col("_i") % block_rows - lack) \
                 .select("_row.*", name.alias("mix_source"), *_ADDED[1:])


def _slot_of(plan, s, block):
    for x in plan:
        if s in x["weights"]:
            total, wt, lo = len(x["table"]), x["weights"][s], x["first"][s]
            j = block - lo
            at = j // wt * total + next(t for n, k, _, _, t in x["table"] if n == s and k == j % wt)
            if at < x["slots"]:
                return x["start"] + at
    raise KeyError((s, block))


def mixed_in_order(mixed: DataFrame) -> DataFrame:
    """The mix as files in training order: ranges of positions, sorted inside."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
