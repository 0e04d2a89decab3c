"""Hard negatives by Four-Russians scoring.

Vectors become integers (``floor(scale * x)``) and are kept as bit planes in
two's complement: one byte holds one bit of eight neighbouring dimensions.  For
an anchor and a group of eight dimensions, a table gives the sum of the anchor's
components over every subset of the eight; a candidate's byte is the index.  The
lookups of one plane are added, planes are shifted and added (the sign plane is
subtracted), which gives the full exact integer inner product.

``hard_negatives`` scores the anchors against all rows in units of ``CHUNK`` rows
times ``BLOCK`` anchors, each one group of a cogroup, so no task holds more than
that whatever one label or vector weighs.  Step one scores rows of the anchor's
own label and keeps the best as positives; step two scores all rows and keeps, per
anchor and positive, the best rows of other labels inside the score window.  A
unit returns its own best rows, windows merge them.

Edge cases: rows with a null label, a null vector or a null or non-finite
component take no part; vectors of different lengths are as if padded by zeros, an
empty one scores zero; ties go to the smaller id, null ids last, and among rows of
one id and score to any of them; repeated rows are rows of their own (a copy of
the anchor is one of its positives); a row with a null anchor mark is no anchor;
an empty table gives an empty result; extra columns are ignored.  Scores that do
not fit 62 bits stop the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CHUNK = 4096
BLOCK = 8192
TABLES = 64  # anchors whose tables are held at once
GROUP = 8


def bit_planes(v):
    """``(planes, rows, groups)`` bytes of an integer matrix in two's complement;
    the last plane is the sign."""
    import numpy as np

    n, dims = v.shape
    width = -(-dims // GROUP) * GROUP
    full = np.zeros((n, width), np.int64)
    full[:, :dims] = v
    top = max(int(full.max(initial=0)).bit_length(), int(~full.min(initial=0)).bit_length()) + 1
    return np.stack([np.packbits((full >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(top)])


def subset_sums(a):
    """``(groups, 256, anchors)``: sums of each anchor's components over every
    subset of eight dimensions."""
    import numpy as np

    n, dims = a.shape
    groups = -(-dims // GROUP)
    full = np.zeros((n, groups * GROUP), a.dtype)
    full[:, :dims] = a
    out = np.zeros((groups, 256, n), a.dtype)
    for j in range(GROUP):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + full[:, j::GROUP].T[:, None]
    return out


def lookup_scores(tables, planes):
    """``(rows, anchors)`` inner products of bit planes with table anchors."""
    import numpy as np

    groups = min(tables.shape[0], planes.shape[2])
    out = np.zeros((planes.shape[1], tables.shape[2]), tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        out <<= 1
        add = np.subtract if p == len(planes) - 1 else np.add
        for g in range(groups):
            add(out, tables[g].take(planes[p, :, g], axis=0), out=out)
    return out


def _planes_of(column):
    """Bit planes of a group's rows, extended to the widest row by sign and zeros."""
    import numpy as np

    raw, dims = column
    groups = -(-dims // GROUP)
    depth = np.array([len(r) // g if g else 0 for r, g in zip(raw, groups)], np.int64)
    out = np.zeros((max(1, depth.max(initial=0)), len(raw), max(1, groups.max(initial=0))), np.uint8)
    for d, g in {(int(d), int(g)) for d, g in zip(depth, groups)}:
        if not d:
            continue
        at = np.flatnonzero((depth == d) & (groups == g))
        some = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), d, g).transpose(1, 0, 2)
        out[:d, at, :g] = some
        out[d:, at, :g] = some[-1]
    return out


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor, scale: int) -> DataFrame:
    """``(id, label, anchor, dims, planes, ints)`` of the rows that take part;
    ``ints`` are the integer components of anchors only."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists, rows = batch.column(3), batch.num_rows
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten()
            x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
            of = np.repeat(np.arange(rows), size)
            bad = np.bincount(of[~np.isfinite(x)], minlength=rows) > 0
            ok = ~bad & np.asarray(lists.is_valid()) & np.asarray(batch.column(1).is_valid())
            ends = np.cumsum(size)
            planes, ints = [None] * rows, [None] * rows
            marked = np.asarray(pc.fill_null(batch.column(2), False))
            for d in set(size[ok].tolist()):
                at = np.flatnonzero(ok & (size == d))
                f = np.floor(scale * x[(ends[at] - d)[:, None] + np.arange(d)])
                if np.abs(f).max(initial=0) >= 2.0 ** 52:
                    raise OverflowError("a component is too large for an exact score")
                v = f.astype(np.int64)
                flatp = np.ascontiguousarray(bit_planes(v).transpose(1, 0, 2)).reshape(len(at), -1)
                for i, r in enumerate(at):
                    planes[r] = flatp[i].tobytes()
                    ints[r] = v[i].tobytes() if marked[r] else None
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marked), pa.array(size.astype(np.int32)),
                 pa.array(planes, pa.binary()), pa.array(ints, pa.binary())],
                ["id", "label", "anchor", "dims", "planes", "ints"])
            yield out.filter(pa.array(ok))

    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), anchor.alias("anchor"),
                         F.col(vec_col).alias("vec"))
    kind = lambda c: src.schema[c].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, anchor boolean, dims int, planes binary, ints binary")


def _unit(rows, anchors, best, result):
    """Score one unit: for each anchor ``best(scores, same_label, anchor number)``
    gives the row numbers kept and, for each, which of the anchor's tasks it is for."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keep = {name: [] for name in ("at", "to", "task", "score")}
    rows = rows.sort_by([("id", "ascending")])  # ties by id, nulls last
    if rows.num_rows and anchors.num_rows:
        column = lambda t, c: t.column(c).combine_chunks()
        dims = np.asarray(rows.column("dims")).astype(np.int64)
        planes = _planes_of((rows.column("planes").to_pylist(), dims))
        label = pa.concat_arrays([column(rows, "label"), column(anchors, "label")])
        label = np.asarray(pc.dictionary_encode(label).indices)
        own, key = label[rows.num_rows:], np.asarray(rows.column("row"))
        akey = np.asarray(anchors.column("row"))
        ints = anchors.column("ints").to_pylist()
        width = max(len(v) // 8 for v in ints)
        a = np.zeros((len(ints), width), np.int64)
        for i, v in enumerate(ints):
            a[i, :len(v) // 8] = np.frombuffer(v, np.int64)
        bound = int(np.abs(a).sum(axis=1).max(initial=0)) << len(planes)
        if bound >= 1 << 62:
            raise OverflowError("scores do not fit 62 bits")
        a = a.astype(np.int32) if bound < 1 << 30 else a
        for lo in range(0, len(a), TABLES):
            s = lookup_scores(subset_sums(a[lo:lo + TABLES]), planes)
            for j in range(s.shape[1]):
                i, col = lo + j, np.ascontiguousarray(s[:, j])
                same = label[:rows.num_rows] == own[i]
                for task, at in best(col, same, key != akey[i], i):
                    keep["at"].append(at)
                    keep["to"].append(np.full(len(at), i))
                    keep["task"].append(np.full(len(at), task))
                    keep["score"].append(col[at].astype(np.int64))
    get = lambda c, t: np.concatenate(keep[c]).astype(t) if keep[c] else np.zeros(0, t)
    return result(rows, anchors, get("at", np.int64), get("to", np.int64), get("task", np.int64), get("score", np.int64))


def _top(score, at, k):
    """The ``k`` of the row numbers ``at`` (ascending) with the highest scores, ties
    by position."""
    import numpy as np

    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.argsort(-score[at].astype(np.int64), kind="stable")][:k]


def _units(rows: DataFrame, anchors: DataFrame, by: list[str]):
    """Both tables dealt out to the groups of a cogroup: rows of one chunk and
    anchors of one block, every chunk with every block of the same ``by``."""
    size = lambda df, k, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(k)).cast("int").alias(name))
    if by:
        sizes = size(rows, CHUNK, "chunks").join(size(anchors, BLOCK, "blocks"), by)
        rows, anchors = rows.join(sizes, by), anchors.join(sizes, by)
    else:
        n = {"chunks": F.lit(max(1, -(-rows.count() // CHUNK))), "blocks": F.lit(max(1, -(-anchors.count() // BLOCK)))}
        rows, anchors = rows.withColumns(n), anchors.withColumns(n)
    number = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    rows = rows.withColumn("chunk", part("chunks")).withColumn("block", number("blocks")).drop("chunks", "blocks")
    anchors = anchors.withColumn("block", part("blocks")).withColumn("chunk", number("chunks")).drop("chunks", "blocks")
    keys = [*by, "chunk", "block"]
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own, as both come from one table
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys))


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``(row, list)``: each anchor's best rows of its own label, best first."""
    def best(score, same, other, i):
        import numpy as np

        yield 0, _top(score, np.flatnonzero(same & other), k)

    def result(rows, anchors, at, to, task, score):
        import pyarrow as pa

        return pa.Table.from_arrays([anchors.column("row").take(to), rows.column("id").take(at), pa.array(score)],
                                    ["row", "id", "score"])

    def run(rows, anchors):
        return _unit(rows, anchors, best, result)

    kind = rows.schema["id"].dataType.simpleString()
    out = _units(rows, anchors, ["label"]).applyInArrow(run, f"row long, id {kind}, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return out.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("list"))


def hard_negatives(vectors: DataFrame, anchor, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", n_positives: int = 5, n_negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For each row marked by the column ``anchor`` and each of its
    ``n_positives`` best rows of the same label, the ``n_negatives`` best rows of
    other labels that score from ``low`` to ``high`` percent of the positive:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = stage(prepared(vectors, id_col, vec_col, label_col, anchor, scale)
                 .withColumn("row", F.monotonically_increasing_id()), "negatives-vectors")
    anchors = rows.where("anchor").select("row", "id", "label", "ints")
    rows = rows.select("row", "id", "label", "dims", "planes")
    found = stage(positives(rows, anchors.drop("id"), n_positives), "negatives-positives")

    def run(rows, anchors):
        import numpy as np
        import pyarrow as pa

        lists = anchors.column("list").to_pylist()

        def best(score, same, other, i):
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in lists[i]]
            inside = ~same & (score >= min(w[0] for w in windows)) & (score <= max(w[1] for w in windows))
            at = np.flatnonzero(inside)
            for task, (least, most) in enumerate(windows):
                yield task, _top(score, at[(score[at] >= least) & (score[at] <= most)], n_negatives)

        def result(rows, anchors, at, to, task, score):
            pick = [lists[i][t] for i, t in zip(to.tolist(), task.tolist())]
            return pa.Table.from_arrays(
                [anchors.column("row").take(to), anchors.column("id").take(to),
                 pa.array([p["place"] for p in pick], pa.int32()),
                 pa.array([p["id"] for p in pick], rows.schema.field("id").type),
                 pa.array([p["score"] for p in pick], pa.int64()), rows.column("id").take(at), pa.array(score)],
                ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

        return _unit(rows, anchors, best, result)

    kind = rows.schema["id"].dataType.simpleString()
    out = _units(rows, anchors.join(found, "row"), []).applyInArrow(
        run, f"row long, anchor_id {kind}, place int, positive_id {kind}, positive_score long, "
             f"negative_id {kind}, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
               .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
