"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against the documents of smaller id: a factor is a run
of at least ``window`` words that stands word for word at one place of one reference
document.  The index gives for each window the smallest document that has it and
its place there.  Windows whose places in one document advance with them are one
factor, also across windows known from a smaller document, as long as the words
between are held by the windows on both sides.  The parse goes from left to right
and takes, of the factors that touch the words parsed so far, the one that reaches
furthest.  Words of the factors taken are duplicate.  A window that straddles two
factors is looked up by itself, so these are exactly the words covered by a window
that starts in a smaller document.

Only the smallest document of a window is a reference of it: a longer factor of a
larger document is found while the stretches of it that smaller documents hold are
shorter than 2 * ``window`` - 1 words each; else it is given as several factors.

The reference index holds all documents as overlapping reference blocks.  The
anchor of a window is its smallest ``gram``-word hash (leftmost on ties), which
depends on the window's words alone: equal windows have equal anchors.
Consecutive windows of one anchor form a block, 13 to 22 words at the defaults.
Per anchor the index keeps the smallest and largest document, its first place in
the smallest and the smallest and largest block hash:

* one document only: nothing to factor;
* one block content in all documents: the whole block is a factor piece of the
  smallest document;
* several contents (ends of shared passages): the anchor's windows, and only
  these, are indexed one by one with hashes of 64 + 32 bits (a document looks up
  its own windows by the first 64).

All steps are equality joins and partial aggregations on narrow rows.  The text
is shuffled once, compressed, by id, to meet its document's matches; steps that
need it twice read the same exchange.

Edge cases: null text has no words; texts shorter than a window keep all;
windows repeated inside one document are no reason to remove; rows that share an
id never remove each other's words and are one reference together, places in any of them; a row with a null id is no reference and
keeps all its words; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty, for_arrow
from .words import SPACE_WORDS, batch_bytes, hashed_groups, mix, window_hashes, _P, _powers

# bits kept of a block's content hash, beside the 64 of its anchor, and of a
# window's second hash, beside the 64 of its first
CONTENT_BITS, SECOND_BITS = 48, 32


def blocks(h, counts, window, gram):
    """Blocks of texts laid end to end: for word hashes ``h`` and words per text
    ``counts`` returns the valid window starts, and per block its first window
    (index into the starts), anchor hash, content hash and place of the anchor."""
    import numpy as np

    n = len(h) - window + 1
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(h))  # words to the end of the text
    starts = np.flatnonzero(left[:max(n, 0)] >= window)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z
    g = window_hashes(h, gram, seed=1)
    best, at = g[:n].copy(), np.zeros(n, dtype=np.int16)
    for j in range(1, window - gram + 1):
        other = g[j:j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    anchor, spot = best[starts], starts + at[starts]
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    a, b = starts[first], starts[last] + window
    pow_, inv = _powers(len(h) + 1)
    pre = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h + np.uint64(2)) * pow_[:len(h)], out=pre[1:])
    content = (pre[b] - pre[a]) * inv[a]
    content = mix(content + (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
                  + (spot[first] - a).astype(np.uint64))
    return starts, first, anchor[first], content, spot[first]


def _firsts(*columns):
    """Places, in order, of the first row of each distinct combination."""
    import numpy as np

    if not len(columns[0]):
        return np.zeros(0, np.int64)
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        key = mix(key + c.view(np.uint64))
    order = np.argsort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return np.sort(np.minimum.reduceat(order, np.flatnonzero(new)))


def _index_rows(window, gram):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data, off = batch_bytes(batch.column(1))
            for lo, hi, counts, h in hashed_groups(data, off, SPACE_WORDS):
                starts, first, anchor, content, spot = blocks(h, counts, window, gram)
                if len(first):
                    ends = np.cumsum(counts)
                    doc = np.searchsorted(ends, starts[first], side="right")
                    content = (content >> np.uint64(64 - CONTENT_BITS)).astype(np.int64)
                    # the first of the equal blocks of one text
                    keep = _firsts(doc, anchor, content)
                    doc = doc[keep]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc + lo)), pa.array(anchor[keep].view(np.int64)),
                         pa.array(content[keep]), pa.array((spot[keep] - (ends - counts)[doc]).astype(np.int32))],
                        ["id", "anchor", "content", "at"])
    return run


def _pack(batches):
    """``(id, text)`` to ``(id, z)``, the text compressed."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, off = batch_bytes(batch.column(1))
        view = memoryview(data)
        z = pa.array([press.compress(view[a:b]) for a, b in zip(off[:-1], off[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), z], ["id", "z"])


def _groups(batch, size=1 << 22):
    """Rows of a packed batch in groups of about ``size`` bytes:
    ``(lo, hi, texts)`` with the texts as an Arrow column."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdDecompressor()
    lo, held, texts = 0, 0, []
    for i, z in enumerate(batch.column(1)):
        texts.append(press.decompress(z.as_buffer()))
        held += len(texts[-1])
        if held >= size or i == batch.num_rows - 1:
            yield lo, i + 1, pa.array(texts, pa.large_binary())
            lo, held, texts = i + 1, 0, []


def _table(lists, values=None, more=None):
    """Distinct keys of a list column, sorted, with their values (null: 0) and
    which values were null, and a second value.  A key has the same values in every row."""
    import numpy as np
    import pyarrow as pa

    flat = lists.flatten()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    keys, first = np.unique(flat.to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
    v = values.flatten().take(pa.array(first))
    gone = v.is_null().to_numpy(zero_copy_only=False)
    number = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return keys, number(v), gone, None if more is None else number(more.flatten().take(pa.array(first)))


def _find(sorted_keys, wanted):
    """(index, found) of each wanted key in sorted keys."""
    import numpy as np

    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return i, sorted_keys[i] == wanted


def _window_hashes_at(h, starts, size, seed=0):
    """``window_hashes`` at some starts only."""
    import numpy as np

    x = mix(h + np.uint64(seed)) if seed else h
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(size):
        out *= _P
        out += x[starts + j]
    return mix(out)


def _open_windows(window, gram):
    """Windows of anchors with several contents: ``(id, w1, w2, at)``, each at its
    first place in a text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo, hi, texts in _groups(batch):
                keys, _, several, _ = _table(batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo))
                keys = keys[several]
                data, off = batch_bytes(texts)
                for glo, _, counts, h in hashed_groups(data, off, SPACE_WORDS):
                    starts, first, anchor, _, _ = blocks(h, counts, window, gram)
                    _, hit = _find(keys, anchor.view(np.int64))
                    s = starts[np.repeat(hit, np.diff(np.concatenate([first, [len(starts)]])))]
                    if len(s):
                        ends = np.cumsum(counts)
                        doc = np.searchsorted(ends, s, side="right")
                        w1 = _window_hashes_at(h, s, window).view(np.int64)
                        w2 = (_window_hashes_at(h, s, window, seed=3) >> np.uint64(64 - SECOND_BITS)).astype(np.int64)
                        at = (s - (ends - counts)[doc]).astype(np.int32)
                        keep = _firsts(doc, w1, w2)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(doc[keep] + lo + glo)), pa.array(w1[keep]),
                             pa.array(w2[keep]), pa.array(at[keep])], ["id", "w1", "w2", "at"])
    return run


def parse(starts, text, ref, place, window):
    """Greedy factors of windows at ``starts`` (rising) of texts number ``text`` that
    stand at ``place`` of ``ref``: first word, end, reference and place of each factor taken, by first word."""
    import numpy as np

    def runs(new, end):
        turn = np.flatnonzero(np.concatenate([[True], new])[:len(end)])
        return turn, end[np.concatenate([turn[1:], [len(end)]])[:len(turn)] - 1]

    shift = place - starts
    differ = lambda *columns: np.any([c[1:] != c[:-1] for c in columns], axis=0)
    # windows one after the other at places one after the other
    turn, end = runs((np.diff(starts) != 1) | differ(text, ref, shift), starts + window)
    first, text, ref, shift = starts[turn], text[turn], ref[turn], shift[turn]
    # and runs of one reference at one shift, with no word left out between them
    order = np.lexsort((first, shift, ref))
    first, end, text, ref, shift = (c[order] for c in (first, end, text, ref, shift))
    turn, end_ = runs(differ(text, ref, shift) | (first[1:] > end[:-1]), end)
    first, end, r, d = first[turn], end_, ref[turn], shift[turn]
    order = np.lexsort((r, -end, first))
    first, end, r, d = first[order], end[order], r[order], d[order]
    taken, i, n = [], 0, len(first)
    reach = np.maximum.accumulate(end)
    furthest = np.maximum.accumulate(np.where(end > np.concatenate([[-1], reach[:-1]])[:n], np.arange(n), 0))
    while i < n:
        # the first factor beyond the words parsed, then those that touch them
        taken.append(i)
        while True:
            last = int(np.searchsorted(first, end[i], side="right")) - 1
            far = int(furthest[last])
            if end[far] <= end[i]:
                i = last + 1
                break
            i = far
            taken.append(i)
    taken = np.array(taken, dtype=np.int64)
    return first[taken], end[taken], r[taken], (first + d)[taken]


def _factor(window, gram):
    """Parse: ``(id, n_words, n_removed, kept, factors)`` per text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        factor_type = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref", pa.int64()),
                                          ("ref_start", pa.int64())]))
        for batch in batches:
            for lo, hi, texts in _groups(batch):
                part = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                keys, refs, several, ats = _table(part[2], part[3], part[4])
                wkeys, wrefs, _, wats = _table(part[5], part[6], part[7])
                ids = part[0].to_numpy(zero_copy_only=False).astype(np.int64)
                data, off = batch_bytes(texts)
                view = memoryview(data)
                n_words, n_removed, kept, factors = [], [], [], []
                for glo, ghi, counts, h in hashed_groups(data, off, SPACE_WORDS):
                    ends = np.cumsum(counts)
                    begins = ends - counts
                    starts, first, anchor, _, spot = blocks(h, counts, window, gram)
                    text = np.searchsorted(ends, starts, side="right")
                    own = ids[text + glo]
                    size = np.diff(np.concatenate([first, [len(starts)]]))
                    at, hit = _find(keys, anchor.view(np.int64))
                    ok, ref = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
                    place = ref.copy()
                    if len(keys):
                        ref = np.repeat(refs[at], size)
                        place = np.repeat(ats[at] - spot, size) + starts
                        ok = np.repeat(hit & ~several[at], size) & (ref < own)
                        if len(wkeys):
                            apart = np.flatnonzero(np.repeat(hit & several[at], size))
                            w, found = _find(wkeys, _window_hashes_at(h, starts[apart], window).view(np.int64))
                            found &= wrefs[w] < own[apart]
                            apart, w = apart[found], w[found]
                            ok[apart], ref[apart], place[apart] = True, wrefs[w], wats[w]
                    a, b, ref, place = parse(starts[ok], text[ok], ref[ok], place[ok], window)
                    drop = np.zeros(len(h) + 1, dtype=np.int64)
                    np.add.at(drop, a, 1)
                    np.add.at(drop, b, -1)
                    gone = np.cumsum(drop)[:len(h)] > 0
                    removed = np.concatenate([[0], np.cumsum(gone)])
                    removed = removed[ends] - removed[begins]
                    doc = np.searchsorted(ends, a, side="right")
                    mine = [[] for _ in counts]
                    for d, x, n, r, p in zip(doc.tolist(), (a - begins[doc]).tolist(), (b - a).tolist(), ref.tolist(), place.tolist()):
                        mine[d].append({"start": x, "n_words": n, "ref": r, "ref_start": p})
                    for i in range(glo, ghi):
                        words = bytes(view[off[i]:off[i + 1]]).split()
                        if removed[i - glo]:
                            out = gone[begins[i - glo]:ends[i - glo]].tolist()
                            words = [w for w, x in zip(words, out) if not x]
                        kept.append(b" ".join(words))
                    n_words.append(counts)
                    n_removed.append(removed)
                    factors += mine
                yield pa.RecordBatch.from_arrays(
                    [part[0], pa.array(np.concatenate(n_words).astype(np.int64)),
                     pa.array(np.concatenate(n_removed).astype(np.int64)),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, factor_type)],
                    ["id", "n_words", "n_removed", "kept", "factors"])
    return run


_PARSED = ("id long, n_words long, n_removed long, kept string, "
           "factors array<struct<start:bigint,n_words:bigint,ref:bigint,ref_start:bigint>>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = 13, gram: int = 4) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_removed``, ``kept`` (kept
    words joined by one space) and ``factors`` (array of first word, number of
    words, reference id, first word there; in word order, neighbours may overlap)."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    src = for_arrow(docs, F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    some = src.where("id IS NOT NULL")
    index = some.mapInArrow(_index_rows(window, gram), "id long, anchor long, content long, at int")
    shared = stage(index.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                                               F.min_by("at", "id").alias("at"), F.min("content").alias("c0"), F.max("content").alias("c1"))
                        .where("lo < hi")
                        .select("anchor", "lo", "at", (F.col("c0") != F.col("c1")).alias("several")), "rlz-index")
    # per document: its anchors with a reference (null: several contents)
    state = (index.select("id", "anchor").join(shared, "anchor")
                  .where("several OR lo < id")
                  .select("id", F.struct("anchor", *[F.when(~F.col("several"), F.col(c)).alias(c) for c in ("lo", "at")])
                                 .alias("s"))
                  .groupBy("id").agg(F.collect_set("s").alias("s"))
                  .select("id", F.col("s.anchor").alias("anchors"), F.col("s.lo").alias("refs"), F.col("s.at").alias("places")))
    # the same filter for both uses below, so that they share one exchange
    text = some.mapInArrow(_pack, "id long, z binary").where("id IS NOT NULL").repartition("id")
    open_ = (text.join(state, "id").select("id", "z", "anchors", "refs")
                 .mapInArrow(_open_windows(window, gram), "id long, w1 long, w2 long, at int"))
    known = (open_.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("at", "id").alias("at"))
                  .where("lo < hi").select("w1", "w2", "lo", "at"))
    # The extra key makes the join deal out both sides anew (the counted side has
    # few rows), so that a window of very many documents can be split over tasks.
    again = F.col("w1").bitwiseAND(F.lit(7)).alias("k")
    hits = (open_.select("id", "w1", "w2", again).join(known.select("*", again), ["k", "w1", "w2"]).where("lo < id")
                 .groupBy("id").agg(F.collect_set(F.struct("w1", "lo", "at")).alias("w"))
                 .select("id", F.col("w.w1").alias("windows"), F.col("w.lo").alias("wrefs"), F.col("w.at").alias("wplaces")))
    parsed = (text.join(state, "id", "left").join(hits, "id", "left")
                  .select("id", "z", "anchors", "refs", "places", "windows", "wrefs", "wplaces")
                  .mapInArrow(_factor(window, gram), _PARSED))
    # rows without an id: nothing to compare them with
    none = (src.where("id IS NULL").mapInArrow(_pack, "id long, z binary")
               .select("id", "z", *[F.lit(None).cast("array<long>").alias(c) for c in ("anchors", "refs", "places", "windows", "wrefs", "wplaces")])
               .mapInArrow(_factor(window, gram), _PARSED))
    return parsed.unionAll(none).withColumnRenamed("id", id_col)
