"""PII: information-theoretic sanitisation.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers
found by fixed patterns; each distinct value is a protected entity.  A term in
the documents of an entity may reveal it even after the entity itself is gone.
How strongly is estimated from the whole corpus.  With document counts over all
rows, the term's pointwise mutual information with the entity and the entity's own
information are

    PMI(t; e) = log2( n(e, t) * N / (n(e) * n(t)) )        IC(e) = log2(N / n(e))

and their difference IC - PMI = log2(n(t) / n(e, t)) is what is still unknown of
the entity once the term is seen, in bits: zero if the term never occurs without
it.  N cancels, so the verdict on a text does not depend on how many other texts
the table holds.  Counts bear no more than their evidence: with k different
contexts (words within ``reach`` of the entity; a document gives one, copies of
one text give the same) the share of the term's documents that hold the entity is
taken ``doubt ** (1 / k)`` times smaller:

    unknown = IC - PMI + log2(doubt) / k

A term that leaves ``generalise`` bits or fewer of some entity is replaced by its
class, one that leaves ``remove`` or fewer is deleted, wherever it occurs in the
table.  With the defaults one context never suffices; removal takes four.

Entities of fewer contexts than could reach a threshold are left out before the
pairs are formed, and a term meets an entity only if its document count can, so a
document of very many addresses and words does not give their product.  Entities
with the same documents have the same counts and are scored once.  Fixed-size
bitmaps of the terms thin the words before the shuffles and decide nothing.

Edge cases: null text counts as empty; very long texts are scanned whole; a term
at a threshold is marked, and of several entities the one it leaves least of
decides; repeated rows count as documents each, of one context; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty, for_arrow
from .term_counts import bitmap, document_counts, term_hashes, wanted_words
from .words import ALNUM_WORDS, batch_bytes, hashed_groups

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD_CHAR = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]")
MARK_BITS = 1 << 25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text):
    """Leftmost non-overlapping matches; linear, as each ``@`` is tried once with
    the whole run of local characters before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text):
    """``(start, kind number, end)`` of all base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            d = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def blocked(spans):
    """Base spans as disjoint ``[start, end]`` in order."""
    merged = []
    for a, b in sorted((a, b) for a, _, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def free(merged, a, b):
    """Whether ``a..b`` touches none of the ``blocked`` spans."""
    from bisect import bisect_right

    lo = bisect_right(merged, a, key=lambda x: x[1])
    return lo == len(merged) or merged[lo][0] >= b


def neighbours(text, spans, reach):
    """For each span, the words up to ``reach`` words before and after it that
    touch no base span."""
    merged = blocked(spans)
    for a, kind, b in spans:
        found, stop = [], a
        for _ in range(reach):  # terms before, nearest first
            end = stop
            while end > 0 and not (text[end - 1] in _ALNUM or text[end - 1] >= "\x80"):
                end -= 1
            start = end
            while start > 0 and (text[start - 1] in _ALNUM or text[start - 1] >= "\x80"):
                start -= 1
            if start == end:
                break
            found.append((start, end))
            stop = start
        found.reverse()
        for n, m in enumerate(_TERM.finditer(text, b)):
            if n == reach:
                break
            found.append(m.span())
        yield (a, kind, b), [text[s:e] for s, e in found if e - s > 1 and free(merged, s, e)]


def other_terms(text, spans):
    """Different terms of two characters or more that touch no base span."""
    out, at = set(), 0
    for a, b in blocked(spans):
        while a > at and _WORD_CHAR.match(text[a]) and _WORD_CHAR.match(text[a - 1]):
            a -= 1
        out.update(_TERM.findall(text[at:a]))
        while b < len(text) and _WORD_CHAR.match(text[b - 1]) and _WORD_CHAR.match(text[b]):
            b += 1
        at = max(at, b)
    out.update(_TERM.findall(text[at:]))
    return sorted(w for w in out if len(w) > 1)


def _entities(reach):
    """Per document with a base span, its entities ``e`` with one context ``c`` each
    and the hashes of its terms."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        sha = lambda s: int.from_bytes(hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
        for batch in batches:
            ents, terms = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                if spans:
                    one = {}
                    for (a, kind, b), words in neighbours(text, spans, reach):
                        e, c = sha(f"{kind}:{text[a:b]}"), sha("\0".join(words))
                        one[e] = min(c, one.get(e, c))
                    ents.append([{"e": e, "c": c} for e, c in one.items()])
                    terms.append(other_terms(text, spans))
            if ents:
                flat, at = term_hashes([w for words in terms for w in words]), 0
                hashed = []
                for words in terms:
                    hashed.append(sorted(set(flat[at:at + len(words)])))
                    at += len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ents, pa.list_(pa.struct([("e", pa.int64()), ("c", pa.int64())]))),
                     pa.array(hashed, pa.list_(pa.int64()))], ["ents", "terms"])
    return run


def pair_counts(docs: DataFrame, text_col: str, reach: int, doubt: float, bits: float) -> tuple[DataFrame, DataFrame]:
    """``(g, n_e, n_entities)``: groups of entities with the same documents, and
    ``(g, t, n_et, n_c)``: documents and different contexts of all pairs that can
    leave ``bits`` bits or fewer."""
    least = max(1, math.ceil(math.log2(doubt) / bits))
    rows = stage(for_arrow(docs, text_or_empty(text_col).alias("text"))
                 .mapInArrow(_entities(reach), "ents array<struct<e:bigint,c:bigint>>, terms array<bigint>")
                 .withColumn("rid", F.monotonically_increasing_id()), "pii-entities")
    ents = rows.select("rid", F.explode("ents").alias("x")).select("rid", "x.e", "x.c")
    # the documents of an entity as count and two sums of hashes, combined before the shuffle
    sets = (ents.groupBy("e", "c").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s1"),
                                       F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("s2"))
                .groupBy("e").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("contexts"),
                                  F.sum("s1").alias("s1"), F.bit_xor("s2").alias("s2"))
                .where(F.col("contexts") >= least))
    sets = stage(sets.select("e", "n_e", F.xxhash64("n_e", "s1", "s2").alias("g")), "pii-entity-groups")
    groups = sets.groupBy("g").agg(F.max("n_e").alias("n_e"), F.count(F.lit(1)).alias("n_entities"))
    mine = stage(ents.join(sets, "e").groupBy("rid", "g").agg(F.min("c").alias("c"), F.max("n_e").alias("n_e")),
                 "pii-entity-documents")
    # a term's documents among these are the least that its count can be; those that
    # cannot reach the bits beside any entity of theirs go before the pairs
    top = mine.groupBy("rid").agg(F.max("n_e").alias("top"))
    terms = rows.join(top, "rid").select("rid", "top", F.explode("terms").alias("t"))
    some = terms.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.max("top").alias("top"))
    some = some.where((F.col("m") >= least) & (F.col("m") <= F.col("top") * F.lit(2.0 ** bits))).drop("top")
    pairs = (terms.join(some, "t").join(mine, "rid").where(F.col("m") <= F.col("n_e") * F.lit(2.0 ** bits))
                  # documents of a pair, and apart from them its different contexts
                  .groupBy("g", "t", "m", "c").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("g", "t", "m").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("n_c"))
                  .where(_unknown("m", doubt) <= bits).drop("m"))
    return stage(groups, "pii-groups"), stage(pairs, "pii-pairs")


def _unknown(n_t: str, doubt: float):
    return F.log2(F.col(n_t) / F.col("n_et")) + F.lit(math.log2(doubt)) / F.col("n_c")


def unknown_bits(docs: DataFrame, text_col: str, reach: int, doubt: float, bits: float) -> DataFrame:
    """``(g, t, n_entities, unknown)`` of every pair that leaves ``bits`` or fewer."""
    groups, pairs = pair_counts(docs, text_col, reach, doubt, bits)
    n_t = stage(document_counts(docs, text_col, pairs.select("t").distinct()), "pii-terms")
    return (pairs.join(n_t, "t").join(groups, "g")
                 .select("g", "t", "n_entities", _unknown("n_t", doubt).alias("unknown")).where(F.col("unknown") <= bits))


def _spans(shared):
    """Base spans, and the places of the terms that the bitmap lets pass."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        mark_type = pa.list_(pa.struct([("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        hit = wanted_words(shared.value, MARK_BITS)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(text) for text in texts]
            marks = [[] for _ in texts]
            data, off = batch_bytes(pc.utf8_lower(batch.column(1)))
            for lo, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                at, ends = hit(h), np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                first, size = np.unique(doc, return_index=True, return_counts=True)[1:]
                for f, n in zip(first.tolist(), size.tolist()):
                    i, begin = lo + int(doc[f]), int(ends[doc[f]] - counts[doc[f]])
                    places = dict(zip((at[f:f + n] - begin).tolist(), h[at[f:f + n]].view(np.int64).tolist()))
                    merged, last = blocked(base[i]), int(at[f + n - 1]) - begin
                    for k, m in enumerate(_TERM.finditer(texts[i])):
                        if k in places and m.end() - m.start() > 1 and free(merged, *m.span()):
                            marks[i].append({"t": places[k], "start": m.start(), "end": m.end()})
                        if k == last:
                            break
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base], span_type),
                 pa.array(marks, mark_type)], ["id", "base", "marks"])
    return run


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 6,
              doubt: float = 3.0, generalise: float = 1.0, remove: float = 0.5) -> DataFrame:
    """One row per document: ``id_col`` and ``spans``, an array of ``start``,
    ``kind`` (number in ``KINDS``) and ``end`` in code points, ordered by start,
    kind and end."""
    found = unknown_bits(docs, text_col, reach, doubt, max(generalise, remove))
    found = stage(found.groupBy("t").agg(F.min("unknown").alias("d")), "pii-disclosures")
    src = for_arrow(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = stage(src.mapInArrow(_spans(bitmap(found, MARK_BITS)),
                                f"id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, "
                                "marks array<struct<t:bigint,start:bigint,end:bigint>>")
                    .withColumn("rid", F.monotonically_increasing_id()), "pii-rows")
    more = (rows.select("rid", F.explode("marks").alias("x")).select("rid", "x.*")
                .join(found, "t")
                .select("rid", F.struct("start", F.when(F.col("d") <= remove, KINDS.index("remove"))
                                                  .otherwise(KINDS.index("generalise")).alias("kind"), "end").alias("s"))
                .groupBy("rid").agg(F.collect_list("s").alias("more")))
    return rows.join(more, "rid", "left").select(
        F.col("id").alias(id_col),
        F.array_sort(F.concat("base", F.coalesce("more", F.expr("array()").cast(
            "array<struct<start:bigint,kind:int,end:bigint>>")))).alias("spans"))


def spans_text(spans, kinds=None):
    """Column: ``kind:start:end`` joined by commas, of the given kind numbers."""
    some = F.filter(spans, lambda s: s["kind"].isin(list(kinds))) if kinds is not None else spans
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of each document rewritten by its spans (one row per
    id in ``spans``): base spans become ``[KIND]``, generalised terms ``[NUMBER]``,
    ``[NAME]`` or ``[TERM]``, removed terms go."""
    marks = {k: f"[{n.upper()}]" for k, n in enumerate(BASE)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if mine and text:
                    parts, at = [], 0
                    for s in mine:
                        if s["start"] < at:  # inside a span already replaced
                            continue
                        word = text[s["start"]:s["end"]]
                        parts.append(text[at:s["start"]])
                        parts.append(marks.get(s["kind"]) or ("" if s["kind"] == KINDS.index("remove") else
                                     "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"))
                        at = s["end"]
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]],
                                             [text_col, *batch.schema.names[2:]])

    rest = [c for c in docs.columns if c != text_col]
    src = docs.join(spans.select(F.col(id_col), F.col("spans").alias("_spans")), id_col, "left") \
              .select(text_col, "_spans", *rest)
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in [text_col, *rest])
    return src.mapInArrow(run, schema).select(*docs.columns)
