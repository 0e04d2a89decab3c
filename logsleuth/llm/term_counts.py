"""Document counts of terms over a whole table.

A fixed-size bitmap of the wanted terms thins the words before the shuffle and
decides nothing by itself: the counts are joined with the wanted terms after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_arrow, text_or_empty
from .words import ALNUM_WORDS, batch_bytes, hashed_groups

BITMAP_BITS = 1 << 22


def term_hashes(terms):
    """64-bit hashes of lower-cased terms, as the corpus scan computes them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not terms:
        return []
    data, off = batch_bytes(pc.utf8_lower(pa.array(terms, pa.large_string())))
    return np.concatenate([h for _, _, _, h in hashed_groups(data, off, ALNUM_WORDS)]).view(np.int64).tolist()


def bitmap(terms: DataFrame, n_bits: int = BITMAP_BITS):
    """Broadcast bitmap of the hashes in column ``t``: ``n_bits`` bits whatever their number."""
    import numpy as np

    places = F.col("t").bitwiseAND(F.lit(n_bits - 1).cast("long"))
    words = (terms.select(places.alias("p")).groupBy(F.expr("cast(p div 64 AS int)").alias("w"))
                  .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")))
    bits = np.zeros(n_bits // 64, dtype=np.int64)
    for r in words.collect():  # at most n_bits / 64 rows
        bits[r["w"]] = r["b"]
    return terms.sparkSession.sparkContext.broadcast(bits.tobytes())


def wanted_words(data: bytes, n_bits: int = BITMAP_BITS):
    """Function from word hashes to the places of those that the bitmap lets pass."""
    import numpy as np

    bits = np.frombuffer(data, dtype=np.uint8)

    def hit(h):
        at = h & np.uint64(n_bits - 1)
        return np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
    return hit


def _document_terms(shared):
    """Documents per term, of the terms that the bitmap lets pass, counted per
    group of texts: ``(t, n)``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        hit = wanted_words(shared.value)
        for batch in batches:
            data, off = batch_bytes(pc.utf8_lower(batch.column(0)))
            for _, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                at = hit(h)
                if len(at):
                    doc = np.searchsorted(np.cumsum(counts), at, side="right")
                    pair = np.unique(np.stack([h[at].view(np.int64), doc]), axis=1)
                    t, n = np.unique(pair[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype(np.int64))], ["t", "n"])
    return run


def document_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """``(t, n_t)``: documents that hold each term whose hash is in column ``t``
    of ``terms`` (and of terms that share a bit with one)."""
    return for_arrow(docs, text_or_empty(text_col).alias("text")) \
        .mapInArrow(_document_terms(bitmap(terms)), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
