"""Records of audit files of any size (SC3, SC6, SC11, SC14).

A whole file in one row ends at the size limit of a VARIANT (128 MiB), and at
2 GB of any value.  Here a file is read as fragments between commas
(``lineSep=","``), so Spark splits a plain file over tasks and streams a
compressed one, and no row is larger than a chunk.

1. Consecutive fragments of one split are joined to chunks of about ``CHUNK``
   characters.  A comma is never inside an escape or a token, so a chunk is
   described by what it does to either string state: whether it flips the state,
   by how much the nesting depth changes and how deep it falls, and at which
   relative depths a ``Records`` key stands.
2. A window over the chunks of a file (narrow rows) carries string state, depth
   and whether the records array is open into every chunk.
3. Each chunk, read again with its state, gives its records; a record over
   several chunks comes in pieces, which meet by its number.  What stands outside
   of the records, the skeleton, is one small text per file.

A file is valid if its skeleton and every record parse, as when it is parsed in
one piece; otherwise it gives one row with an error.  Without a ``Records`` key an
object is itself the record, which then has the size limit of one VARIANT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

CHUNK = 256 << 10
WHOLE_BYTES = 64 << 20
# DEFLATE expands at most 1032 times, so a compressed file below this bound fits a VARIANT
WHOLE_COMPRESSED_BYTES = (128 << 20) // 1032
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
INVALID = "Invalid JSON in CloudTrail log"
TOO_LARGE = "A record or the text outside of the records is above the size limit"
VARIANT_BYTES = 128 << 20


def fits_whole(path, size, whole_bytes: int = WHOLE_BYTES):
    """Column: whether a file is small enough to be parsed in one piece."""
    packed = min(whole_bytes, WHOLE_COMPRESSED_BYTES)
    return size <= F.when(F.lower(path).rlike(COMPRESSED), packed).otherwise(whole_bytes)


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/records/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _structure(data):
    """Unescaped quotes, and places and signs of brackets, of a chunk's bytes."""
    import numpy as np

    other = np.flatnonzero(data != 92)
    q = np.flatnonzero(data == 34)
    before = np.searchsorted(other, q) - 1
    run = q - 1 - np.where(before >= 0, other[np.maximum(before, 0)], -1)
    q = q[run % 2 == 0]
    opening = (data == 123) | (data == 91)
    at = np.flatnonzero(opening | (data == 125) | (data == 93))
    return q, at, np.where(opening[at], 1, -1)


_KEY = rb'"Records"[\x20\t\r\n]*:[\x20\t\r\n]*(\[?)'


def _keys(raw, q, state):
    """``Records`` keys outside of other strings: (start, place of the bracket or -1)."""
    import re

    import numpy as np

    out = []
    for m in re.finditer(_KEY, raw):
        i = int(np.searchsorted(q, m.start()))
        if i < len(q) and q[i] == m.start() and (i + state) % 2 == 0:
            out.append((m.start(), m.start(1) if m.group(1) else -1))
    return out


def _effects(raw: bytes) -> list:
    """What a chunk does to each string state: flip, then for either state the
    depth change, the lowest depth after a bracket, the depths of keys and of arrays
    still open."""
    import numpy as np

    data = np.frombuffer(raw, np.uint8)
    q, at, sign = _structure(data)
    inside = np.searchsorted(q, at)
    out = [len(q) % 2 == 1]
    for state in (0, 1):
        use = (inside + state) % 2 == 0
        places, depth = at[use], np.cumsum(sign[use])
        low = np.minimum.accumulate(depth[::-1])[::-1]  # lowest from here to the end
        keys, still = set(), set()
        for start, bracket in _keys(raw, q, state):
            i = int(np.searchsorted(places, start))
            r = int(depth[i - 1]) if i else 0
            keys.add(r)
            if bracket >= 0 and low[int(np.searchsorted(places, bracket))] > r:
                still.add(r)
        out += [int(depth[-1]) if len(depth) else 0, int(depth.min()) if len(depth) else None,
                sorted(keys), sorted(still)]
    return out


def _pieces(raw: bytes, kind: str, state: int, depth: int, inside: bool, done: bool):
    """``(text, starts, ends, number)`` of the records or parts of records of a
    chunk, and the chunk's part of the skeleton."""
    import numpy as np

    data = np.frombuffer(raw, np.uint8)
    q, at, sign = _structure(data)
    use = (np.searchsorted(q, at) + state) % 2 == 0
    places, sign = at[use], sign[use]
    after = depth + np.cumsum(sign)
    level = 1 if kind == "[" else 2
    if kind == "[":
        opens = places[(sign > 0) & (after == 1)]
    else:
        opens = [b for _, b in _keys(raw, q, state) if b >= 0 and after[int(np.searchsorted(places, b))] == 2]
        opens = np.array(opens, np.int64)
    end = places[(sign < 0) & (after == 0)]  # what follows the first value is ignored, as by the parser
    opens = opens[:0] if done else opens[opens < end[0]] if len(end) else opens
    closes = places[(sign < 0) & (after == level - 1)]
    commas = np.flatnonzero(data == 44)
    commas = commas[(np.searchsorted(q, commas) + state) % 2 == 0]
    i = np.searchsorted(places, commas)
    commas = commas[np.where(i > 0, after[np.maximum(i, 1) - 1] if len(after) else depth, depth) == level]
    out, skeleton, number, cur = [], [], 0, 0
    fresh = not inside or (depth == level and state == 0)
    while cur <= len(raw):
        if not inside:
            k = int(np.searchsorted(opens, cur))
            stop = int(opens[k]) + 1 if k < len(opens) else len(raw)
            skeleton.append(raw[cur:stop])
            if k == len(opens):
                break
            cur, inside, fresh = stop, True, True
            continue
        k = int(np.searchsorted(closes, cur))
        stop, closed = (int(closes[k]), True) if k < len(closes) else (len(raw), False)
        cuts = commas[(commas >= cur) & (commas < stop)].tolist()
        for a, b in zip([cur, *(c + 1 for c in cuts)], [*cuts, stop]):
            last = b == stop and not (cuts and b == cuts[-1])
            if last and not closed and a == stop:
                break  # the chunk ends with a record
            ends = not last or closed
            text = raw[a:b] if ends or b < len(raw) else raw[a:b - 1]  # the comma put at the end joins the pieces
            out.append((text, fresh, ends, number if fresh else -1))
            number, fresh = number + fresh, True
        if not closed:
            break
        cur, inside = stop, False
    return out, b"".join(skeleton)


_CHUNK_SCHEMA = ("path string, block long, seq int, bytes long, text string, kind string, flip boolean, "
                 + ", ".join(f"d{s} int, low{s} int, keys{s} array<int>, open{s} array<int>" for s in (0, 1)))


def chunks(fragments: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of ``path, block, value`` fragments in reading order, and their effects."""
    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in _CHUNK_SCHEMA.split(", ")]
        types = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("bytes", pa.int64()),
                           ("text", pa.string()), ("kind", pa.string()), ("flip", pa.bool_()),
                           *[x for s in (0, 1) for x in ((f"d{s}", pa.int32()), (f"low{s}", pa.int32()),
                                                         (f"keys{s}", pa.list_(pa.int32())), (f"open{s}", pa.list_(pa.int32())))]])
        key, seq, parts, held = None, 0, [], 0

        def row():
            text = ",".join(parts) + ","
            raw = text.encode("utf-8", "surrogatepass")
            first = text.lstrip(" \t\r\n﻿")[:1]
            return dict(zip(names, [*key, seq, len(raw), text, first if first != "," else None, *_effects(raw)]))

        for batch in batches:
            done = []
            for path, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (path, block) != key:
                    if parts:
                        done.append(row())
                    key, seq, parts, held = (path, block), 0, [], 0
                parts.append(value)
                held += len(value) + 1
                if held >= size:
                    done.append(row())
                    seq, parts, held = seq + 1, [], 0
                    if len(done) >= 32:
                        yield pa.RecordBatch.from_pylist(done, types)
                        done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
        if parts:
            yield pa.RecordBatch.from_pylist([row()], types)

    return fragments.select("path", "block", "value").mapInArrow(run, _CHUNK_SCHEMA)


def chunk_states(effects: DataFrame) -> DataFrame:
    """``path, block, seq`` with what holds at the chunk's start: ``kind`` of the
    file, string ``state``, ``depth``, ``inside`` the records, ``has`` records,
    ``done`` with the first value."""
    order = Window.partitionBy("path").orderBy("block", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = effects.withColumn("state", F.coalesce(F.sum(F.col("flip").cast("int")).over(before), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("state") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    x = x.select("path", "block", "seq", "bytes", "kind", "state", *[pick(c).alias(c) for c in ("d", "low", "keys", "open")])
    x = x.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    top = (F.lit(1) - F.col("depth")).cast("int")
    x = x.withColumn("after", F.when(F.array_contains("open", top), True)
                               .when(F.col("depth") + F.col("low") <= 1, False))
    done = F.coalesce(F.max(F.col("depth") + F.col("low") <= 0).over(before), F.lit(False))
    kind = F.first("kind", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = F.coalesce(F.last("after", ignorenulls=True).over(before), F.lit(False))
    return x.select("path", "block", "seq", "bytes", "state", F.col("depth").cast("int").alias("depth"), kind.alias("kind"),
                    (~done & F.when(kind == "[", F.col("depth") >= 1).otherwise(carried)).alias("inside"),
                    (~done & F.array_contains("keys", top)).alias("has"), done.alias("done"))


def split_records(fragments: DataFrame, size: int = CHUNK) -> DataFrame:
    """``path, record_index, record, error`` of all files: a VARIANT per record, and
    one row with an error (and nothing else) per file that is not valid."""
    each = chunks(fragments, size)
    states = _staged(chunk_states(each.drop("text")), "states")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, block, seq, text, kind, state, depth, inside, done in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                found, skeleton = _pieces(raw, kind or "", state, depth, inside, done)
                text_of = lambda b: b.decode("utf-8", "surrogatepass")
                rows += [(path, block, seq, n, a, b, text_of(t)) for t, a, b, n in found]
                rows.append((path, block, seq, None, None, None, text_of(skeleton)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(),
                                                          pa.bool_(), pa.string()))],
                ["path", "block", "seq", "number", "starts", "ends", "text"])

    pieces = (each.select("path", "block", "seq", "text").join(states, ["path", "block", "seq"])
                  .select("path", "block", "seq", "text", "kind", "state", "depth", "inside", "done")
                  .mapInArrow(run, "path string, block long, seq int, number int, starts boolean, ends boolean, text string"))
    pieces = _staged(pieces, "pieces")

    # number of each record in its file: records begun in earlier chunks, then its own place
    begun = pieces.where("starts").groupBy("path", "block", "seq").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (states.select("path", "block", "seq").join(begun, ["path", "block", "seq"], "left")
                     .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    parts = pieces.where("starts IS NOT NULL").join(offsets, ["path", "block", "seq"]) \
                  .withColumn("record_index", F.col("offset") + F.col("number"))
    whole = parts.where("starts AND ends").select("path", "record_index", "text")
    order = F.struct("block", "seq", "text")
    cut = (parts.where("NOT (starts AND ends)").groupBy("path", "record_index")
                .agg(F.array_sort(F.collect_list(order)).alias("p"))
                .select("path", "record_index", F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("text")))
    texts = whole.unionByName(cut)
    skeletons = (pieces.where("starts IS NULL").groupBy("path").agg(F.array_sort(F.collect_list(order)).alias("p"))
                       .select("path", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), r",\s*$", "")
                               .alias("skeleton")))

    blank = F.trim(F.translate("text", "\t\r\n", "   ")) == ""
    records = texts.withColumn("record", F.try_parse_json("text"))
    checked = records.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"),
                                          F.count_if(F.col("record").isNull() & ~blank).alias("bad"),
                                          F.max(F.octet_length("text")).alias("largest"))
    kinds = states.groupBy("path").agg(F.bool_or("has").alias("has"), F.max("kind").alias("kind"))
    doc = F.try_parse_json("skeleton")
    files = (skeletons.join(kinds, "path").join(checked, "path", "left")
                      .withColumn("doc", doc)
                      .withColumn("single", (F.col("kind") == "{") & ~F.coalesce("has", F.lit(False)))
                      .fillna({"n": 0, "blank": 0, "bad": 0, "largest": 0}))
    listed = (F.col("kind") == "[") | F.try_variant_get("doc", "$.Records", "array<variant>").isNotNull()
    good = (F.col("doc").isNotNull() & F.col("kind").isin("[", "{") & (F.col("single") | listed)
            & (F.col("bad") == 0) & ((F.col("blank") == 0) | (F.col("n") == 1)))
    large = F.greatest("largest", F.octet_length("skeleton")) >= VARIANT_BYTES
    files = _staged(files.select("path", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce("single", F.lit(False)).alias("single"),
                                 F.when(F.coalesce(large, F.lit(False)), TOO_LARGE).otherwise(INVALID).alias("error"),
                                 F.when(F.col("single"), F.col("skeleton")).alias("skeleton")), "files")
    kept = files.where("good AND NOT single").select("path")
    none = F.lit(None)
    return (records.where(~blank).join(kept, "path", "left_semi")
                   .select("path", F.col("record_index").cast("long"), "record", none.cast("string").alias("error"))
                   .unionByName(files.where("good AND single").select(
                       "path", F.lit(0).cast("long").alias("record_index"), F.try_parse_json("skeleton").alias("record"),
                       none.cast("string").alias("error")))
                   .unionByName(files.where("NOT good").select("path", none.cast("long").alias("record_index"),
                                                               none.cast("variant").alias("record"), "error")))


def fragments(spark: SparkSession, paths, recursive: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``path, block, value, file_size`` of the files too large to be parsed whole,
    read between commas."""
    df = spark.read.option("lineSep", ",").option("recursiveFileLookup", str(recursive).lower()).text(paths)
    meta = F.col("_metadata")
    return (df.where(~fits_whole(meta["file_path"], meta["file_size"], whole_bytes))
              .select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), "value",
                      meta["file_size"].alias("file_size")))
