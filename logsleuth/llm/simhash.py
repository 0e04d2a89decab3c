"""SimHash near-duplicates by deletion-variant signatures.

``fingerprints`` gives each text a 64-bit SimHash over word shingles.
``links`` finds all pairs of distinct fingerprints at ``max_bits`` differing
bits or fewer without comparing all pairs: a fingerprint is cut into
``max_bits // 2 + 1`` segments, so of two linked fingerprints one segment
differs by at most one bit.  Each segment is indexed once unchanged and once
per bit with that bit as a wildcard; equal index keys are joined and the join
condition verifies the bit distance, so only true links leave the join.
``near_duplicates`` groups documents by the connected components of the links.

Edge cases: null or empty text has no shingle and fingerprint zero, which links
like any other; a text of fewer words than a shingle uses its whole word
sequence; equal texts share a fingerprint and are collapsed before the index;
repeated rows and ties give one output row per input row; a null id keeps its
row and is never a component id unless all ids of the component are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage, text_or_empty, for_arrow

BITS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 15  # shingles whose bits are held at once


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    import numpy as np
    import xxhash

    words = text.translate(_LOWER).split()
    n = len(words) - shingle + 1
    if n < 1:
        grams, n = iter([b" ".join(words)]), min(1, len(words))
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    if n == 0:
        return 0
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        some = [digest(g, seed) for g, _ in zip(grams, range(min(_BLOCK, n - start)))]
        bits = np.unpackbits(np.frombuffer(b"".join(some), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp)`` for every row."""
    from .words import batch_bytes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = batch_bytes(batch.column(1))
            view = memoryview(data)
            fps = [simhash(bytes(view[a:b]), shingle, seed) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    src = for_arrow(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp long").select(F.col("id").alias(id_col), "fp")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(a, b, bits)``: pairs of distinct fingerprints at ``max_bits`` or fewer
    differing bits, ``a < b``; a pair may appear more than once.  ``fps`` has one
    row per distinct fingerprint in column ``fp``."""
    if not 1 <= max_bits <= 31:
        raise ValueError("max_bits must be from 1 to 31")
    parts = max_bits // 2 + 1
    edges = [BITS * i // parts for i in range(parts + 1)]
    # (segment number, wildcard bit or none, segment value without that bit)
    keys = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        width = hi - lo
        seg = F.col("fp") if width == BITS else F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))
        tag = lambda w, v, i=i: F.struct(F.lit(i * (BITS + 1) + w).cast("short").alias("t"), v.alias("v"))
        one = lambda b: F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")
        none = F.struct(tag(BITS, seg).alias("k"), F.lit(None).cast("boolean").alias("bit"))
        keys += [none] + [F.struct(tag(b, seg.bitwiseAND(F.bitwise_not(one(b)))).alias("k"),
                                   (seg.bitwiseAND(one(b)) != 0).alias("bit")) for b in range(width)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("e")).select("fp", "e.k.*", "e.bit")
    # A wildcard key joins the two values of its bit; the unchanged segment is
    # compared within itself.  Equal segments thus meet once, not once per bit.
    left = rows.where(F.coalesce(F.col("bit"), F.lit(False)) == F.lit(False))
    right = rows.where(F.coalesce(F.col("bit"), F.lit(True)) == F.lit(True))
    left = left.select("t", "v", F.col("fp").alias("x"))
    right = right.select("t", "v", F.col("fp").alias("y"))
    bits = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    exact_once = (F.col("t") % (BITS + 1) != BITS) | (F.col("x") < F.col("y"))
    # Spark sizes the exploded keys like the fingerprints they come from, and below
    # its threshold would broadcast them: some 34 rows of each fingerprint.
    return (left.hint("merge").join(right, ["t", "v"]).where((bits <= max_bits) & exact_once)
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), bits.alias("bits")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (signed 64-bit fingerprint),
    ``component_id`` (smallest id reachable over links) and ``n_links`` (number
    of other distinct fingerprints linked to its own)."""
    each = stage(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-docs")
    # equal fingerprints meet in one row; the partial minimum absorbs hot groups
    groups = stage(each.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-fps")
    pairs = stage(links(groups.select("fp"), max_bits).distinct(), "simhash-links")
    roots = components(pairs)
    degree = (pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp")
                   .agg(F.count(F.lit(1)).alias("n_links")))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
                   .withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = stage(rooted.join(least, "root").join(degree, "fp", "left")
                        .select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")),
                  "simhash-groups")
    return each.join(table, "fp").select(id_col, "fp", "component_id", "n_links")
