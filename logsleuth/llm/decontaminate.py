"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits.  A seed is a fixed mask over
consecutive tokens that looks at some positions and ignores the others, so a
seed still hits when an ignored token was substituted.  Hashes of every mask at
every token of the benchmark are joined with those of the documents; each hit
names a diagonal (document position minus item position).  The diagonal is
verified token by token: some segment must hold ``min_match`` matching tokens
(``identity`` of the tokens of an item, if those are fewer) at ``identity`` or
more.  Reported is the segment of the best sum of +1 for a match and -2 for a
substitution if it is such a segment, else the one with the most matches.

Every item is indexed by all of ``MASKS`` and ``SHORT_MASKS``.  Over all ways to
substitute a quarter of the tokens, enumerated in the tests, one of them always
hits for items of 8 to 28 tokens; the first four alone miss a fifth at 16 tokens.

A benchmark of up to ``block_bytes`` of text (checked) is indexed once and sent to
all tasks: one pass over the documents, which are never shuffled.  A larger one is
joined instead: its seeds are made in tasks, a bitmap of fixed size thins the seeds
of the documents, both meet in an equality join on the seed, and each diagonal is
verified where the tokens of the document along it meet those of the item.  Texts
are known by their digest there, so repeated rows meet once.  Both ways give the
same rows.

Edge cases: null or empty texts have no tokens and no hits; items of fewer than
``short`` tokens match nothing (they would be ordinary phrases); repeated items are reported one
by one; repeated documents give a row each; empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_arrow, stage, text_or_empty
from .term_counts import wanted_words
from .words import ALNUM_WORDS, batch_bytes, hashed_groups, mix

# fixed masks: 1 looks at the token, 0 ignores it
MASKS = ("1111111", "1101100111", "11100101011", "1010011011001")
# every 6 of 8, 7 of 9, 8 of 10, 9 of 11 or 12, 10 of 13, 11 of 14 and 12 of 15 tokens hold one of these
SHORT_MASKS = ("11101", "100111", "1101001")
BLOCK_BYTES = 32 << 20
# the bitmap of a joined benchmark: 32 MB whatever the benchmark
SEED_BITS = 1 << 28


def seeds(h, mask, number):
    """Hash of ``mask`` at every token position of one run of token hashes."""
    import numpy as np

    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, dtype=np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j:j + n]
    return mix(out)


def best_segment(equal):
    """(start, end, matches) of the segment with the best sum of +1 for a match
    and -2 for a substitution; ``equal`` is a boolean array."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[:end + 1]))
    return start, end, int(equal[start:end].sum())


def any_segment(equal, need, identity):
    """(start, end, matches) of the segment with the most matches among all with
    ``need`` matches or more at ``identity`` or more, from match to match; None
    without one."""
    import numpy as np

    m = np.concatenate([[0], np.cumsum(equal)])
    score = m - identity * np.arange(len(m))
    # the last end whose score is not below that of each start
    after = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-after, -score + 1e-9, side="right") - 1
    n = m[end] - m
    start = int(np.argmax(n))
    if n[start] < max(need, 1):
        return None
    at = np.flatnonzero(equal[start:end[start]]) + start
    return int(at[0]), int(at[-1]) + 1, len(at)


def verified(equal, n_item, min_match, identity):
    """(start, end, matches) of the reported segment of a diagonal of an item of
    ``n_item`` tokens; None if no segment is long and like enough."""
    need = min(min_match, math.ceil(identity * n_item))
    if equal.sum() < need:
        return None
    a, b, n = best_segment(equal)
    if n < need or n < identity * (b - a):
        return any_segment(equal, need, identity)
    return (a, b, n) if n else None


def _token_hashes(texts):
    """(counts, hashes) of a list of texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    data, off = batch_bytes(pc.utf8_lower(pa.array(texts, pa.large_string())))
    parts = list(hashed_groups(data, off, ALNUM_WORDS))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def build_index(texts, masks, short):
    """Benchmark block as numpy arrays: token hashes, offsets, seed hashes, and the
    numbers of the masks in use."""
    import numpy as np

    counts, h = _token_hashes(texts)
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    keys, items, places, used = [], [], [], set()
    for i in range(len(texts)):
        own = h[off[i]:off[i + 1]]
        if len(own) < short:
            continue
        for m, mask in enumerate(masks):
            k = seeds(own, mask, m)
            if len(k):
                used.add(m)
            keys.append(k)
            items.append(np.full(len(k), i))
            places.append(np.arange(len(k)))
    z = np.zeros(0, np.int64)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    items, places = np.concatenate(items) if items else z, np.concatenate(places) if places else z
    order = np.argsort(keys, kind="stable")
    return {"h": h, "off": off, "keys": keys[order], "items": items[order], "places": places[order],
            "used": used}


def _scan(index, ids, masks, min_match, short, identity):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        x = index.value
        keys, bits = x["keys"], 22
        table = np.zeros(1 << bits, dtype=bool)  # quick refusal by the top bits
        table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        for batch in batches:
            data, off = batch_bytes(pc.utf8_lower(batch.column(1)))
            rows = []
            for lo, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                ends = np.cumsum(counts)
                found = set()
                for m, mask in enumerate(masks):
                    if m not in x["used"]:
                        continue
                    s = seeds(h, mask, m)
                    at = np.flatnonzero(table[(s >> np.uint64(64 - bits)).astype(np.int64)])
                    a = np.searchsorted(keys, s[at], side="left")
                    b = np.searchsorted(keys, s[at], side="right")
                    for p, i, j in zip(at[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist()):
                        d = int(np.searchsorted(ends, p, side="right"))
                        begin = int(ends[d] - counts[d])
                        if p + len(mask) <= ends[d]:
                            for k in range(i, j):
                                found.add((d, int(x["items"][k]), p - begin - int(x["places"][k])))
                best = {}
                for d, item, diagonal in found:
                    begin = int(ends[d] - counts[d])
                    theirs = x["h"][x["off"][item]:x["off"][item + 1]]
                    first, stop = max(0, -diagonal), min(len(theirs), int(counts[d]) - diagonal)
                    equal = theirs[first:stop] == h[begin + first + diagonal:begin + stop + diagonal]
                    segment = verified(equal, len(theirs), min_match, identity)
                    if segment:
                        a, b, n = segment
                        got = (n, -(first + a + diagonal), first + a, b - a)
                        if got > best.get((d, item), (0,)):
                            best[(d, item)] = got
                rows += [(lo + d, ids[item], -g[1], g[2], g[3], g[0]) for (d, item), g in sorted(best.items())]
            if rows:
                doc, item, start, place, length, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(place, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(n, pa.int64())],
                    ["id", "item", "doc_start", "item_start", "n_tokens", "n_match"])
    return run


def _tokens(batches):
    """``(key, text)`` to ``(key, tokens)``, the token hashes of each text as bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        data, off = batch_bytes(pc.utf8_lower(batch.column(1)))
        for lo, hi, counts, h in hashed_groups(data, off, ALNUM_WORDS):
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo),
                 pa.array([h[e - c:e].tobytes() for e, c in zip(ends, counts)], pa.binary())], ["key", "tokens"])


def _seed_rows(masks, short=0, shared=None):
    """``(key, text)`` to ``(key, n, seed, place)`` for texts of ``short`` tokens or
    more: every seed, or those that the bitmap ``shared`` lets pass."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        hit = (lambda s: np.arange(len(s))) if shared is None else wanted_words(shared.value, SEED_BITS)
        for batch in batches:
            data, off = batch_bytes(pc.utf8_lower(batch.column(1)))
            for lo, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                ends = np.cumsum(counts)
                for m, mask in enumerate(masks):
                    s = seeds(h, mask, m)
                    at = hit(s)
                    d = np.searchsorted(ends, at, side="right")
                    ok = (at + len(mask) <= ends[d]) & (counts[d] >= short)
                    at, d = at[ok], d[ok]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(lo + d)), pa.array(counts[d].astype(np.int64)),
                             pa.array(s[at].view(np.int64)), pa.array(at - (ends[d] - counts[d]))],
                            ["key", "n", "seed", "place"])
    return run


def _slices(batches, size=4 << 20):
    """``(key, text, hits)`` to the tokens of the text along each diagonal of
    ``hits``: ``(item_key, key, diagonal, tokens)``, in batches of about ``size`` bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["item_key", "key", "diagonal", "tokens"])

    for batch in batches:
        data, off = batch_bytes(pc.utf8_lower(batch.column(1)))
        for lo, hi, counts, h in hashed_groups(data, off, ALNUM_WORDS):
            ends, rows, held = np.cumsum(counts), [], 0
            for i in range(lo, hi):
                count, end = int(counts[i - lo]), int(ends[i - lo])
                for x in batch.column(2)[i]:
                    diagonal, n = x["diagonal"].as_py(), x["n"].as_py()
                    a, b = max(diagonal, 0), min(diagonal + n, count)
                    rows.append((x["item_key"].as_py(), batch.column(0)[i].as_py(), diagonal,
                                 h[end - count + a:end - count + b].tobytes()))
                    held += len(rows[-1][3]) + 64
                    if held >= size:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def _verify(min_match, identity):
    """``(item_key, key, diagonal, tokens, theirs)`` to verified segments."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep, segments = [], []
            for i in range(batch.num_rows):
                diagonal = batch.column(2)[i].as_py()
                ours, theirs = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 4))
                first = max(0, -diagonal)
                got = verified(theirs[first:first + len(ours)] == ours, len(theirs), min_match, identity)
                if got:
                    keep.append(i)
                    segments.append((first + got[0] + diagonal, first + got[0], got[1] - got[0], got[2]))
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)),
                     *[pa.array(c, pa.int64()) for c in zip(*segments)]],
                    ["item_key", "key", "doc_start", "item_start", "n_tokens", "n_match"])
    return run


def _seed_bitmap(seed_rows: DataFrame):
    """Broadcast bitmap of ``SEED_BITS`` bits of the seeds."""
    bits = bytearray(SEED_BITS // 8)
    place = F.col("seed").bitwiseAND(F.lit(SEED_BITS - 1).cast("long"))
    parts = (seed_rows.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("w"))
                      .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("b")))
    for r in parts.toLocalIterator():  # at most SEED_BITS / 32768 rows of 4 kB
        bits[r["w"] * 4096:(r["w"] + 1) * 4096] = r["b"]
    return seed_rows.sparkSession.sparkContext.broadcast(bytes(bits))


def _joined(src: DataFrame, items: DataFrame, masks, min_match, short, identity) -> DataFrame:
    """Overlaps with a benchmark of any size: seeds meet in an equality join."""
    digest = F.unhex(F.md5("text"))
    src, items = src.withColumn("key", digest), items.withColumn("item_key", digest)
    texts = stage(items.select(F.col("item_key").alias("key"), "text").dropDuplicates(["key"]), "benchmark-texts")
    row = "key binary, n long, seed long, place long"
    index = stage(texts.mapInArrow(_seed_rows(masks, short), row), "benchmark-seeds")
    mine = index.select(F.col("key").alias("item_key"), "n", "seed", F.col("place").alias("item_place"))
    doc_text = src.select("key", "text")
    hits = (doc_text.mapInArrow(_seed_rows(masks, shared=_seed_bitmap(index)), row).select("key", "seed", "place")
                    .join(mine, "seed")
                    .select("key", "item_key", "n", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct())
    # a list as long as its own text has hits
    hits = stage(hits.groupBy("key").agg(F.collect_list(F.struct("item_key", "n", "diagonal")).alias("hits")),
                 "benchmark-hits")
    theirs = texts.mapInArrow(_tokens, "key binary, tokens binary").select(
        F.col("key").alias("item_key"), F.col("tokens").alias("theirs"))
    along = (doc_text.join(hits, "key").select("key", "text", "hits")
                     .mapInArrow(_slices, "item_key binary, key binary, diagonal long, tokens binary"))
    best = (along.join(theirs, "item_key").select("item_key", "key", "diagonal", "tokens", "theirs")
                 .mapInArrow(_verify(min_match, identity), "item_key binary, key binary, doc_start long, "
                                                           "item_start long, n_tokens long, n_match long")
                 .groupBy("key", "item_key")
                 .agg(F.max(F.struct("n_match", (-F.col("doc_start")).alias("back"), "item_start", "n_tokens")).alias("b")))
    best = stage(best, "benchmark-best").select("key", "item_key", (-F.col("b.back")).alias("doc_start"), "b.item_start",
                                                "b.n_tokens", "b.n_match")
    return (src.select("id", "key").join(best, "key").join(items.select("item", "item_key"), "item_key")
               .select("id", "item", "doc_start", "item_start", "n_tokens", "n_match"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, min_match: int = 12,
             short: int = 8, identity: float = 0.75, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated document and benchmark item, its best verified
    segment: ``id_col``, ``item_col``, ``doc_start`` and ``item_start`` (tokens),
    ``n_tokens``, ``n_match``, ``similarity``."""
    spark = docs.sparkSession
    masks = tuple(dict.fromkeys((*masks, *SHORT_MASKS)))
    # an item too short for a mask still needs a seed
    masks += ("1" * short,) if short < min(map(len, masks)) else ()
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_or_empty(item_text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    src = for_arrow(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    if int(total) <= block_bytes:  # rows and texts together are bounded
        block = items.orderBy("item").collect()
        index = spark.sparkContext.broadcast(build_index([r["text"] for r in block], masks, short))
        kind = src.schema["id"].dataType.simpleString()
        out = src.mapInArrow(_scan(index, [r["item"] for r in block], masks, min_match, short, identity),
                             f"id {kind}, item long, doc_start long, item_start long, n_tokens long, n_match long")
    else:
        out = _joined(src, items, masks, min_match, short, identity)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "doc_start", "item_start",
                      "n_tokens", "n_match", (F.col("n_match") / F.col("n_tokens")).alias("similarity"))
