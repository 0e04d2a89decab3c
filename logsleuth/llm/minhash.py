"""MinHash near-duplicates with odd sketches.

``signatures`` gives each text the set of its distinct word shingles as 64-bit
hashes, ``SAMPLES`` MinHash values of it, the keys of ``BANDS`` bands of ``ROWS``
values, and an odd sketch: each (sample number, value) flips one bit of a bitmap
of ``SKETCH_BITS``, so the bits that differ between two sketches count the
samples that differ.  ``near_duplicates`` links texts at a Jaccard similarity of
``percent`` or more:

1. Texts of one set meet in one class (equal sets are equal by 128 hash bits).
2. Classes that share a band key form a bucket.  Each is compared with the
   bucket's leader, one of four orders per bucket so that a group has several
   leaders; pairs pass if sizes and sketches allow the similarity and are then
   confirmed on the full sets.  A large group of near copies needs one pair a
   member and leader for this, not all pairs.
3. What is still apart in one bucket is compared pair by pair, within the join:
   members of other components than the bucket's largest against all others.
   Besides size and sketch, the two must share a shingle of their prefixes: in
   rarest-first order, sets of n and m shingles that share c meet in the first
   n - c + 1 and m - c + 1, and a similarity s needs c = s (n + m) / (1 + s).
   Any one order of all shingles loses no pair; theirs is by counts of
   ``COUNTS`` cells of hashes, a table of fixed size.  Survivors are confirmed
   on the full sets.
4. Components of all links.

Full sets are the bulk of the data.  They are made again from the texts where they
are needed, only for the classes in question, and are not shuffled for the counts
and prefixes.  For a confirmation they go by ``dealt`` to cells of a family's
pairs: a set is sent once a cell, however many pairs it has there.

No stage caps candidates.  A link is missed only if no band meets or if its
sketches differ in more than ``sketch_limit`` bits: at the lowest similarity of
0.8 below 4e-6, far less above it.

Edge cases: null and empty texts and texts without words have an empty set and
link with nothing; fewer words than a shingle make one shingle of the whole
sequence; very long texts are hashed in pieces, whole; repeated rows and ties
give one output row per input row, with the smallest id of the component; a null
id keeps its row and is a component id only if all ids of the component are
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, for_arrow, stage, text_or_empty

SAMPLES = 128
ROWS = 4
BANDS = 24
SKETCH_BITS = 512
MISS = 1e-7  # chance that a link's sketches differ in more bits than allowed
WORDS = SKETCH_BITS // 64
BLOCK = 256  # sets on one side of a cell
ID_BITS = 1 << 25  # the bitmap of wanted ids: 4 MB whatever the table
COUNTS = 1 << 22  # cells of shingle counts, a byte each


def sketch_limit(percent: int, samples: int = SAMPLES, bits: int = SKETCH_BITS, miss: float = MISS) -> int:
    """Most differing bits that two sketches of sets at ``percent`` similarity may
    have, up to a chance of ``miss``: the exact distribution over the number of
    differing samples (binomial; each flips two bits) and of odd bins."""
    import numpy as np
    from math import comb

    p = 1 - percent / 100
    odd, total = np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0] = 1.0
    j = np.arange(bits + 1)
    for d in range(samples + 1):
        total += comb(samples, d) * p ** d * (1 - p) ** (samples - d) * odd
        for _ in range(2):
            up, down = odd * (bits - j) / bits, odd * j / bits
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    tail = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(tail > miss)[-1])


def shingle_hashes(counts, h, size: int):
    """``(text number, hash)`` of the distinct shingles of consecutive texts with
    ``counts`` words and word hashes ``h``, sorted by both."""
    import numpy as np
    from .words import mix, window_hashes

    doc = np.repeat(np.arange(len(counts)), counts)
    w = window_hashes(h, size)
    inside = doc[:len(w)] == doc[size - 1:] if len(w) else np.zeros(0, bool)
    d, w = doc[:len(w)][inside], w[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = np.cumsum(counts)
        whole = [window_hashes(h[ends[i] - counts[i]:ends[i]], int(counts[i]))[0] for i in short]
        d = np.concatenate([d, short])
        w = np.concatenate([w, mix(np.array(whole, np.uint64) + np.uint64(1))])
    order = np.lexsort((w, d))
    d, w = d[order], w[order]
    first = np.ones(len(w), bool)
    first[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    return d[first], w[first]


def _groups(column, size):
    """``(lo, hi, text number, shingle hash)`` of the texts of an Arrow column."""
    import numpy as np
    from .words import SPACE_WORDS, batch_bytes, hashed_groups

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data, off = batch_bytes(column)
    base = int(off[0]) if len(off) else 0
    data, off = lower[data[base:int(off[-1]) if len(off) else 0]], off - base
    for lo, hi, counts, h in hashed_groups(data, off, SPACE_WORDS):
        yield lo, hi, *shingle_hashes(np.asarray(counts), h, size)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = 2) -> DataFrame:
    """``(id, n, key, bands, sketch)`` for every row: size of the set, its 128-bit
    hash (null for the empty set), band keys and the sketch's 64-bit words."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from .words import mix

        u64 = np.uint64
        mul = mix(np.arange(1, SAMPLES + 1, dtype=u64)) | u64(1)
        add = mix(np.arange(SAMPLES + 1, 2 * SAMPLES + 1, dtype=u64))
        number = np.arange(SAMPLES, dtype=u64)[:, None] << u64(32)
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, np.int32)
            keys = np.zeros((rows, 2), u64)
            bands = np.zeros((rows, BANDS), u64)
            sketch = np.zeros((rows, SKETCH_BITS // 8), np.uint8)
            for lo, hi, doc, w in _groups(batch.column(1), shingle):
                if not len(w):
                    continue
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                at = lo + doc[starts]
                n[at] = np.diff(starts, append=len(w))
                keys[at, 0] = np.add.reduceat(mix(w), starts)
                keys[at, 1] = np.add.reduceat(mix(w ^ u64(0xA5A5A5A5A5A5A5A5)), starts)
                low = np.empty((SAMPLES, len(starts)), u64)
                for i in range(SAMPLES):
                    low[i] = np.minimum.reduceat((w * mul[i] + add[i]) >> u64(32), starts)
                for b in range(BANDS):
                    k = np.full(len(starts), b, u64)
                    for v in low[b * ROWS:(b + 1) * ROWS]:
                        k = mix(k * u64(0x9E3779B97F4A7C15) + v)
                    bands[at, b] = k
                bit = (mix(low | number) % u64(SKETCH_BITS)).astype(np.int64)
                cell = (np.arange(len(starts)) * SKETCH_BITS + bit).ravel()
                odd = np.bincount(cell, minlength=len(starts) * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
                sketch[at] = np.packbits(odd.astype(np.uint8), axis=1)
            flat = keys.tobytes()
            some = [flat[16 * i:16 * i + 16] if n[i] else None for i in range(rows)]
            longs = lambda x, k: pa.ListArray.from_arrays(
                pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(x.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(some, pa.binary()), longs(bands, BANDS), longs(sketch, WORDS)],
                ["id", "n", "key", "bands", "sketch"])

    src = for_arrow(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n int, key binary, bands array<long>, sketch array<long>")


def _places(ids):
    """Where the ids of a column are in the bitmap; null has a place too."""
    return F.xxhash64(ids).bitwiseAND(F.lit(ID_BITS - 1).cast("long"))


def _id_bitmap(ids: DataFrame):
    """Broadcast bitmap of ``ID_BITS`` bits of the column ``id``."""
    bits = bytearray(ID_BITS // 8)
    parts = (ids.select(_places(F.col("id")).alias("p")).groupBy(F.expr("p div 32768").alias("w"))
                .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("b")))
    for r in parts.collect():  # at most ID_BITS / 32768 rows of 4 kB
        bits[r["w"] * 4096:(r["w"] + 1) * 4096] = r["b"]
    return ids.sparkSession.sparkContext.broadcast(bytes(bits))


def _set_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, shared, rows, schema: str) -> DataFrame:
    """``rows(text number, shingle hash, first place of each text)`` of the texts with
    words whose id the bitmap ``shared`` lets pass.  No text is shuffled."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            wanted = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for _, _, doc, w in _groups(batch.column(1).filter(pa.array(wanted.astype(bool))), shingle):
                if len(w):
                    yield rows(doc, w, np.flatnonzero(np.diff(doc, prepend=-1)))

    return for_arrow(docs, _places(F.col(id_col)).alias("place"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, schema)


def _keys(w, starts):
    """The sets' 128-bit hashes, as in ``signatures``."""
    import numpy as np
    import pyarrow as pa
    from .words import mix

    pair = np.stack([np.add.reduceat(mix(w), starts),
                     np.add.reduceat(mix(w ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)], axis=1).tobytes()
    return pa.array([pair[16 * i:16 * i + 16] for i in range(len(starts))], pa.binary())


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, ids: DataFrame) -> DataFrame:
    """``(key, shingles)`` for the rows with words whose id is in ``ids``, and for
    some others: the set's hash and members."""
    def rows(doc, w, starts):
        import numpy as np
        import pyarrow as pa

        ends = pa.array(np.append(starts, len(w)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [_keys(w, starts), pa.ListArray.from_arrays(ends, pa.array(w.view(np.int64)))], ["key", "shingles"])

    return _set_rows(docs, id_col, text_col, shingle, _id_bitmap(ids), rows, "key binary, shingles array<long>")


def _count_levels(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted):
    """Broadcast of a byte for each of ``COUNTS`` cells of shingle hashes that grows
    with the number of sets that hold a shingle of the cell."""
    def rows(doc, w, starts):
        import numpy as np
        import pyarrow as pa

        cell, count = np.unique((w % np.uint64(COUNTS)).astype(np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count.astype(np.int64))], ["cell", "c"])

    def dense(table):
        import numpy as np
        import pyarrow as pa

        levels = np.zeros(4096, np.uint8)
        levels[table.column("cell").to_numpy() % 4096] = np.minimum(12 * np.log2(1 + table.column("c").to_numpy()), 255)
        return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.array([levels.tobytes()], pa.binary())],
                                    ["block", "levels"])

    counts = (_set_rows(docs, id_col, text_col, shingle, wanted, rows, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c"))
              .withColumn("block", F.expr("cell div 4096")))
    levels = bytearray(COUNTS)
    for r in counts.groupBy("block").applyInArrow(dense, "block long, levels binary").collect():
        levels[r["block"] * 4096:(r["block"] + 1) * 4096] = r["levels"]  # at most COUNTS / 4096 rows of 4 kB
    return docs.sparkSession.sparkContext.broadcast(bytes(levels))


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, ids: DataFrame, percent: int) -> DataFrame:
    """``(key, prefix)``: the rarest n - ceil(percent n) + 1 shingles of each set, by
    the counts of their cells and then their hashes, as 32-bit values."""
    wanted = _id_bitmap(ids)
    shared = _count_levels(docs, id_col, text_col, shingle, wanted)

    def rows(doc, w, starts):
        import numpy as np
        import pyarrow as pa

        level = np.frombuffer(shared.value, np.uint8)[(w % np.uint64(COUNTS)).astype(np.int64)]
        n = np.diff(starts, append=len(w))
        length = n - -(n * percent // -100) + 1
        turn = np.lexsort((w, level, doc))
        kept = np.arange(len(w)) - np.repeat(starts, n) < np.repeat(length, n)
        values = (w[turn[kept]] & np.uint64(0x7FFFFFFF)).astype(np.int32)
        ends = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [_keys(w, starts), pa.ListArray.from_arrays(ends, pa.array(values))], ["key", "prefix"])

    return _set_rows(docs, id_col, text_col, shingle, wanted, rows, "key binary, prefix array<int>")


def _size_fits(n1, n2, percent):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _sketch_fits(s1: str, s2: str, percent):
    bits = sum((F.bit_count(F.col(s1)[i].bitwiseXOR(F.col(s2)[i])) for i in range(WORDS)), F.lit(0))
    return bits <= sketch_limit(percent)


def _prefixes_fit(n1, n2, p1, p2, percent):
    """Whether two sets share a shingle of the prefixes that their sizes leave."""
    total = (n1.cast("long") + n2) * percent
    shared = F.floor((total + (99 + percent)) / F.lit(100 + percent)).cast("int")
    return F.arrays_overlap(F.slice(p1, F.lit(1), n1 - shared + 1), F.slice(p2, F.lit(1), n2 - shared + 1))


def dealt(pairs: DataFrame) -> DataFrame:
    """``(cell, a, b)`` of pairs ``(family, a, b)``: families of up to ``BLOCK`` sets
    on either side share cells, larger ones have a cell for each two blocks."""
    few = -(-pairs.count() // BLOCK) or 1
    number = lambda c: F.ceil(F.count_distinct(c) / F.lit(BLOCK)).cast("int")
    sizes = pairs.groupBy("family").agg(number("a").alias("na"), number("b").alias("nb"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col(f"n{c}"))
    cell = (F.when((F.col("na") == 1) & (F.col("nb") == 1), F.xxhash64(F.pmod(F.xxhash64("family"), F.lit(few))))
             .otherwise(F.xxhash64("family", block("a"), block("b"))))
    return pairs.join(sizes, "family").select(cell.alias("cell"), "a", "b")


def _reach(percent: int):
    """The pairs of one cell whose sets reach the similarity."""
    def run(sets, pairs):
        import numpy as np
        import pyarrow as pa

        cid, lists = sets.column("cid").to_numpy(), sets.column("shingles").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        _, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(number), bool)
        order = np.argsort(cid)
        a, b = (order[np.searchsorted(cid, pairs.column(c).to_numpy(), sorter=order)] for c in "ab")
        turn = np.argsort(a, kind="stable")
        found = [np.zeros(0, np.int64)]
        for one in np.split(turn, np.flatnonzero(np.diff(a[turn])) + 1):
            if not len(one):
                continue
            x, y = a[one[0]], b[one]
            mine = number[starts[x]:starts[x] + n[x]]
            mark[mine] = True
            first = np.cumsum(n[y]) - n[y]
            at = np.repeat(starts[y] - first, n[y]) + np.arange(n[y].sum())
            both = np.add.reduceat(mark[number[at]], first, dtype=np.int64)
            mark[mine] = False
            found.append(one[both * (100 + percent) >= (n[x] + n[y]) * percent])
        return pairs.select(["a", "b"]).take(pa.array(np.concatenate(found)))
    return run


def confirmed(pairs: DataFrame, near: DataFrame, docs: DataFrame, id_col: str, text_col: str,
              shingle: int, percent: int) -> DataFrame:
    """The pairs ``(family, a, b)`` of the classes ``near`` whose full sets reach the
    similarity, as ``(a, b)``."""
    pairs = stage(dealt(pairs), "minhash-cells")
    ends = pairs.select("cell", F.col("a").alias("cid")).union(pairs.select("cell", F.col("b").alias("cid")))
    cells = ends.groupBy("cid").agg(F.collect_set("cell").alias("cells"))
    cells = stage(cells.join(near.select("cid", "key", "id"), "cid"), "minhash-members")
    sets = (shingle_sets(docs, id_col, text_col, shingle, cells).join(cells.drop("id"), "key").groupBy("key")
            .agg(F.first("cid").alias("cid"), F.first("cells").alias("cells"), F.first("shingles").alias("shingles"))
            .select(F.explode("cells").alias("cell"), "cid", "shingles"))
    return sets.groupBy("cell").cogroup(pairs.groupBy("cell")).applyInArrow(_reach(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id`` (smallest
    id reachable over links) and ``component_docs`` (documents of the component)."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    each = stage(signatures(docs, id_col, text_col, shingle), "minhash-docs")
    classes = stage(each.where("key IS NOT NULL").groupBy("key")
                        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"),
                             F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
                        .withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")

    # buckets of two classes or more, each row with the bucket's leader; one exchange
    # of the rows serves the count and the join
    rows = classes.select("cid", F.explode("bands").alias("band")).repartition("band")
    turn = F.xxhash64(F.col("band").bitwiseAND(F.lit(3)), "cid")
    lead = rows.groupBy("band").agg(F.min_by("cid", turn).alias("leader"), F.count(F.lit(1)).alias("size"))
    rows = stage(rows.join(lead.where("size > 1").drop("size"), "band"), "minhash-buckets")

    # the classes that share a bucket
    near = stage(rows.select("cid").distinct().join(classes, "cid").drop("docs"), "minhash-near")
    check = lambda pairs: confirmed(pairs, near, docs, id_col, text_col, shingle, percent)

    side = lambda i: near.select("cid", "n", "sketch").toDF("ab"[i], f"n{i + 1}", f"k{i + 1}")
    star = (rows.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
                .join(side(0), "a").join(side(1), "b")
                .where(_size_fits(F.col("n1"), F.col("n2"), percent) & _sketch_fits("k1", "k2", percent)))
    star = star.select(F.min("a").over(Window.partitionBy("b")).alias("family"), "a", "b")
    links = stage(check(stage(star, "minhash-star-pairs")), "minhash-star")
    label = components(links)

    # buckets that still hold several components
    rows = rows.select("band", "cid").join(label.withColumnRenamed("node", "cid"), "cid", "left") \
               .select("band", "cid", F.coalesce("root", "cid").alias("label"))
    per = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = per.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("most"),
                                    F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    rows = stage(rows.join(mixed, "band"), "minhash-mixed")
    apart = stage(near.join(rows.select("cid").distinct(), "cid"), "minhash-apart")
    short = prefixes(docs, id_col, text_col, shingle, apart, percent).join(apart, "key").groupBy("key")
    short = short.agg(*[F.first(c).alias(c) for c in ("cid", "n", "sketch", "bands", "prefix")]).drop("key")
    rows = rows.join(stage(short, "minhash-prefixes"), "cid")
    columns = lambda i: [F.col(c).alias(f"{c}{i}") for c in ("cid", "label", "n", "sketch", "prefix", "bands")]
    one = rows.where("label <> most").select("band", *columns(1))
    two = rows.select("band", "most", *columns(2))
    # a pair of several common bands is taken in one of them
    once = F.array_min(F.array_intersect("bands1", "bands2")) == F.col("band")
    cross = one.join(two, "band").where(
        (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("most")) | (F.col("cid1") < F.col("cid2")))
        & _size_fits(F.col("n1"), F.col("n2"), percent) & _sketch_fits("sketch1", "sketch2", percent)
        & _prefixes_fit(F.col("n1"), F.col("n2"), F.col("prefix1"), F.col("prefix2"), percent) & once)
    cross = stage(cross.select(F.col("most").alias("family"), F.col("cid1").alias("a"), F.col("cid2").alias("b")), "minhash-cross")
    more = stage(check(cross), "minhash-links")

    # components of the first step joined by the further links
    root = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    merged = components(more.join(root("a"), "a", "left").join(root("b"), "b", "left")
                            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    rooted = (classes.join(label.select(F.col("node").alias("cid"), F.col("root").alias("r1")), "cid", "left")
                     .withColumn("r1", F.coalesce("r1", "cid"))
                     .join(merged.select(F.col("node").alias("r1"), F.col("root").alias("r2")), "r1", "left")
                     .select("key", "id", "docs", F.coalesce("r2", "r1").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("docs").alias("component_docs"))
    table = stage(rooted.join(least, "root").select("key", "component_id", "component_docs"), "minhash-components")
    return (each.select("id", "n", "key").join(table, "key", "left")
                .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                        F.coalesce("component_docs", F.lit(1)).alias("component_docs")))
