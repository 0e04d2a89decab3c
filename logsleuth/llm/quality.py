"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a sparse vector of two blocks: hashed byte trigrams (content) and word
shapes (letter case, digits, marks, length, repetition of a recent word).  Term
frequencies are damped by the logarithm, weighted by inverse document frequency
and each block is scaled to length 1.  A truncated singular value decomposition
of the labelled sample gives the latent axes.

The labelled sample is bounded (``max_labelled`` rows, smallest hash first, one
row per distinct text), so its latent vectors can be broadcast: at the defaults
4,096 x 64 floats, 1 MB.  Every document is then projected and compared with
all labelled vectors, exactly, in blocks of a matrix product; its ``k`` nearest
vote with their label, weighted by a power of the cosine.

Edge cases: null or empty text has no terms; its score is the share of label 1
in the sample; ids with several label rows count as label 1 only if all are 1;
null labels are ignored; without any labelled row every score is 0.5; repeated
rows score the same; an empty table gives an empty result; extra columns are
ignored.  The id is used only to find a row's label and whether it is held out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, for_arrow
from .words import SPACE_WORDS, batch_bytes, PIECE, _powers, mix

TRIGRAMS, SHAPES = 2048, 2048
MAX_LABELLED, AXES, NEIGHBOURS, POWER = 4096, 64, 15, 8


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _counts(data, off, out, skip=0):
    """Add term counts of consecutive texts (a group below ``PIECE`` bytes or one
    piece of a long text) to the rows of ``out``.  The first ``skip`` bytes of a
    piece were counted with the one before and are only looked back at."""
    import numpy as np

    n = len(data)
    if n == 0:
        return
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if n >= 3:
        x = data.astype(np.uint32)
        tri = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35))
        tri = ((tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
        same = doc[2:] == doc[:-2]
        same[:max(0, skip - 2)] = False
        idx = doc[2:][same] * (TRIGRAMS + SHAPES) + tri[same]
        out += np.bincount(idx, minlength=out.size).reshape(out.shape)
    ok = SPACE_WORDS[data]
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1] | (doc[1:] != doc[:-1])
    last[:-1] &= ~ok[1:] | (doc[1:] != doc[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return

    def has(mask):
        c = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(mask, out=c[1:])
        return c[e] - c[s]

    upper = has((data >= 65) & (data <= 90))
    lower = has(((data >= 97) & (data <= 122)) | (data >= 128))
    digit = has((data >= 48) & (data <= 57))
    size = e - s
    mark = size - upper - lower - digit
    pow_, inv = _powers(n)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pow_[:n], out=pre[1:])
    h = mix((pre[e] - pre[s]) * inv[s])
    again = np.zeros(len(s), dtype=bool)
    for back in range(1, 4):
        again[back:] |= (h[back:] == h[:-back]) & (doc[s[back:]] == doc[s[:-back]])
    tail = data[e - 1].astype(np.int64)
    letter = (upper + lower) > 0
    shape = ((upper > 1) * 1 + (lower > 0) * 2 + letter * 4 + (digit > 0) * 8 + np.minimum(mark, 3) * 16
             + again * 64 + np.minimum(size // 4, 3) * 128)
    # shape, and the closing mark of the word with its count
    closing = np.where(((tail >= 48) & (tail <= 57)) | ((tail >= 65) & (tail <= 90))
                       | ((tail >= 97) & (tail <= 122)) | (tail >= 128), 0, tail) * 4 + np.minimum(mark, 3)
    row, new = doc[s] * (TRIGRAMS + SHAPES) + TRIGRAMS, s >= skip
    for term in (shape, 512 + closing):
        out += np.bincount((row + term)[new], minlength=out.size).reshape(out.shape)


def _pieces(data, a, b, size):
    """``(back, start, end)`` of the pieces of a long text ``a..b``: each ends at the
    end of a word, and ``back`` is three words (two bytes at least) before it, so
    that nothing is counted otherwise than in one pass."""
    import numpy as np

    start = a
    while start < b:
        end = min(start + size, b)
        while end < b and SPACE_WORDS[data[end]]:
            gap = np.flatnonzero(~SPACE_WORDS[data[end:min(end + size, b)]])
            end = end + int(gap[0]) if len(gap) else min(end + size, b)
        back, look = a, 64
        while start - look > a:
            ok = SPACE_WORDS[data[start - look:start]]
            words = np.flatnonzero(ok[1:] & ~ok[:-1]) + 1
            if len(words) >= 3:
                back = start - look + int(words[-3])
                break
            look *= 4
        yield min(back, max(a, start - 2)), start, end
        start = end


def term_counts(column):
    """Term counts of an Arrow string column, in blocks of rows:
    yields ``(lo, hi, counts)``."""
    import numpy as np

    data, off = batch_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 512)
        out = np.zeros((hi - lo, TRIGRAMS + SHAPES), dtype=np.int64)
        a, b = int(off[lo]), int(off[hi])
        if b - a <= PIECE:
            _counts(data[a:b], off[lo:hi + 1] - a, out)
        else:  # one long text, in pieces
            for back, c, d in _pieces(data, a, b, PIECE):
                _counts(data[back:d], np.array([0, d - back]), out, c - back)
        yield lo, hi, out
        lo = hi


def weigh(counts, idf):
    """Damped, weighted, block-normalised rows (float32)."""
    import numpy as np

    x = np.log1p(counts).astype(np.float32) * idf
    for block in (slice(0, TRIGRAMS), slice(TRIGRAMS, None)):
        norm = np.linalg.norm(x[:, block], axis=1, keepdims=True)
        x[:, block] /= np.where(norm == 0, 1, norm)
    return x


def unit(x):
    import numpy as np

    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def fit(counts, labels, axes=AXES):
    """Model from the sample's term counts and 0/1 labels."""
    import numpy as np

    n = len(labels)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weigh(counts, idf)
    k = min(axes, *x.shape)
    # range finder with power iterations, fixed start
    rng = np.random.default_rng(7)
    q = np.linalg.qr(x.T @ rng.standard_normal((n, min(2 * k, n)), dtype=np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v[:k].T).astype(np.float32)
    return {"idf": idf, "basis": basis, "vectors": unit(x @ basis).astype(np.float32),
            "labels": np.asarray(labels, dtype=np.float32), "prior": float(np.mean(labels))}


def vote(model, counts, k=NEIGHBOURS, power=POWER):
    """Scores of rows of term counts."""
    import numpy as np

    x = unit(weigh(counts, model["idf"]) @ model["basis"])
    cos = x @ model["vectors"].T
    k = min(k, cos.shape[1])
    near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k:]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** power
    total = w.sum(axis=1)
    score = (w * model["labels"][near]).sum(axis=1) / np.where(total == 0, 1, total)
    score = np.where((counts.sum(axis=1) == 0) | (total == 0), model["prior"], score)
    return np.round(np.clip(score, 0, 1), 6)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_labelled: int = MAX_LABELLED, axes: int = AXES) -> dict | None:
    """Fit on at most ``max_labelled`` labelled rows that are not held out."""
    import numpy as np

    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
                   .groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label")))
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    chosen = (known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_labelled))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, c in term_counts(batch.column(1)):
                at = [np.flatnonzero(r).astype(np.uint16) for r in c]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([x.tobytes() for x in at], pa.binary()),
                     pa.array([r[x].astype(np.uint32).tobytes() for r, x in zip(c, at)], pa.binary())],
                    ["id", "label", "terms", "counts"])

    src = for_arrow(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    # bounded: max_labelled ids; one row per id and per distinct text
    sample = (src.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
                 .dropDuplicates(["text", "label"]).select("id", "text", "label")
                 .mapInArrow(run, f"id {kind}, label int, terms binary, counts binary"))
    rows = [(r["id"], r["label"], np.frombuffer(r["terms"], dtype=np.uint16), np.frombuffer(r["counts"], dtype=np.uint32))
            for r in sample.collect()]  # at most max_labelled sparse rows
    if not rows:
        return None
    rows.sort(key=lambda r: r[0])
    counts = np.zeros((len(rows), TRIGRAMS + SHAPES), dtype=np.float32)
    for i, (_, _, at, c) in enumerate(rows):
        counts[i, at] = c
    return fit(counts, [r[1] for r in rows], axes)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          k: int = NEIGHBOURS, keep: tuple = (), prefix: str = "") -> DataFrame:
    """Score every document: ``id_col``, ``keep`` columns, ``held_out``, ``score``,
    ``predicted``, the last three with ``prefix`` before their names."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([id_col, *keep]))
    sent = list(dict.fromkeys([*cols, text_col]))
    src = for_arrow(docs, *sent).withColumn(text_col, F.col(text_col).cast("string"))
    at, n_kept, name = sent.index(text_col), len(cols), f"{prefix}score"

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if m is not None:
                for lo, hi, c in term_counts(batch.column(at)):
                    s[lo:hi] = vote(m, c, k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(s)],
                                             [*batch.schema.names[:n_kept], name])

    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in cols)
    return (src.mapInArrow(run, f"{schema}, `{name}` double")
               .withColumn(f"{prefix}held_out", held_out(id_col))
               .withColumn(f"{prefix}predicted", F.when(F.col(name) >= 0.5, 1).otherwise(0))
               .select(*cols, f"{prefix}held_out", name, f"{prefix}predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_labelled: int = MAX_LABELLED, k: int = NEIGHBOURS,
             keep: tuple = ()) -> DataFrame:
    """Train on the labelled rows that are not held out, then score all rows."""
    return score(docs, train(docs, labels, id_col, text_col, label_col, max_labelled), id_col, text_col, k, keep)
