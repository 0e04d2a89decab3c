"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

A text is cut into statements (lines, and sentences inside lines; a statement
above ``2 * half`` terms into overlapping windows of that size).  Consecutive
statements are also scored together up to ``2 * half`` terms, and windows of that
size run over line ends, as a wrapped declaration stands on several lines.
Statements and templates are sparse TF-IDF vectors over lower-case alphanumeric
terms; document frequencies of all terms are counted over all documents.  A
statement takes the license of the template with the highest cosine of
``threshold`` or more; a file takes its best statement.

Few statements can reach the threshold at all: by Cauchy-Schwarz one must hold a
term of the heaviest terms of a template whose remaining terms weigh less than
``threshold`` of its norm.  Only statements with such a term are compared, and
the result is the same as with all of them.  Terms of no template only add to the
norm of a statement, each by its idf of 1 or more; the statements that could still
reach the threshold are kept once per bag of terms, and the documents of their
outside terms are counted and joined back on the term hash.

Files without a statement inherit the license of the license files in the
nearest ancestor directory that has one.  Distinct directories, not files, are
joined with their ancestors' licenses.

Edge cases: null or empty text has no statement; a null path has no directory
and inherits nothing; of several licenses in a file or directory the most
similar, then the first name, then the smallest path counts; repeated rows give
a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty, for_arrow
from .term_counts import document_counts, term_hashes
from .words import ALNUM_WORDS, batch_bytes, hashed_groups

# License names and statements that declare them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_TERM = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?;])\s+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text)


def vector(words, idf, rare):
    """Sparse vector of length 1: term to weight."""
    tf = {}
    for w in words:
        tf[w] = tf.get(w, 0) + 1
    v = {w: (1 + math.log(n)) * idf.get(w, rare) for w, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()} if norm else {}


def triggers(vectors, threshold):
    """Terms of which a statement must hold one to reach the threshold."""
    out = set()
    for v in vectors:
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda e: (-e[1], e[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            out.add(w)
            rest -= x * x
    return out


def statements(text: str, half: int):
    """Term lists of the statements of a lower-case text."""
    for part in _CUT.split(text):
        words = terms(part)
        if len(words) <= 2 * half:
            if words:
                yield words
        else:
            for i in range(0, len(words) - half, half):
                yield words[i:i + 2 * half]


def joined(text: str, half: int, heavy):
    """Term lists of runs of consecutive statements of up to ``2 * half`` terms and
    of windows of that size over line ends, those with a term of ``heavy``."""
    parts = [w for w in map(terms, _CUT.split(text)) if w]
    has = [not heavy.isdisjoint(w) for w in parts]
    near = [i for i, x in enumerate(has) if x]
    at = 0
    for i in range(len(parts)):
        while at < len(near) and near[at] < i:
            at += 1
        if at == len(near):
            break
        if near[at] - i >= 2 * half:  # each part has a term
            continue
        run = list(parts[i])
        for j in range(i + 1, len(parts)):
            if len(run) + len(parts[j]) > 2 * half:
                break
            run = run + parts[j]
            if j >= near[at]:
                yield run
    words = [w for part in parts for w in part]
    for i in range(0, len(words) - half, half):
        window = words[i:i + 2 * half]
        if not heavy.isdisjoint(window):
            yield window


def _lower(column):
    """Lower-case, as the term counts and the comparison both see it."""
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def template_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> tuple[int, dict[str, int]]:
    """Number of documents, and documents that hold each template term."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        data, off = batch_bytes(pa.array(vocabulary, pa.large_string()))
        known = np.concatenate([h for _, _, _, h in hashed_groups(data, off, ALNUM_WORDS)])
        order = np.argsort(known)
        keys = known[order]
        total = np.zeros(len(keys), dtype=np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            data, off = batch_bytes(_lower(batch.column(0)))
            for _, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                doc = np.searchsorted(np.cumsum(counts), hit, side="right")
                pair = np.unique(doc * len(keys) + at[hit])
                total += np.bincount(pair % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([*(vocabulary[i] for i in order), ""]),
                                          pa.array([*total.tolist(), n], pa.int64())], ["term", "n"])

    rows = (for_arrow(docs, text_or_empty(text_col).alias("text")).mapInArrow(run, "term string, n long")
                .groupBy("term").agg(F.sum("n").alias("n")).collect())  # one row per template term
    df = {r["term"]: r["n"] for r in rows}
    return df.pop("", 0), df


def own_licenses(docs: DataFrame, id_col: str, path_col: str, text_col: str, templates, threshold: float,
                 half: int) -> DataFrame:
    """``(id, path, license, similarity)`` for every row."""
    bags = [(name, terms(text.lower())) for name, text in templates]
    vocabulary = sorted({w for _, b in bags for w in b})
    n, df = template_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    vectors = [(name, vector(b, idf, 0.0)) for name, b in bags]
    heavy = sorted(triggers([v for _, v in vectors], threshold))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        data, off = batch_bytes(pa.array(heavy, pa.large_string()))
        keys = np.sort(np.concatenate([h for _, _, _, h in hashed_groups(data, off, ALNUM_WORDS)]))
        heavy_set, memo, postings = frozenset(heavy), {}, {}
        for i, (_, t) in enumerate(vectors):
            for w, x in t.items():
                postings.setdefault(w, []).append((i, x))

        def best(words):
            """Key, template, dot product and squared norm inside the vocabulary, and the
            other terms with their squared weights; None where the threshold is out of reach."""
            key = tuple(sorted(words))
            if key not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                tf = {}
                for w in key:
                    tf[w] = tf.get(w, 0) + 1
                dots, inside, outside = [0.0] * len(vectors), 0.0, []
                for w, k in tf.items():
                    if w in idf:
                        x = (1 + math.log(k)) * idf[w]
                        inside += x * x
                        for i, y in postings[w]:
                            dots[i] += x * y
                    else:
                        outside.append((w, (1 + math.log(k)) ** 2))
                norm = math.sqrt(inside)
                _, at = max((round(d / norm, 6), -i) for i, d in enumerate(dots))
                memo[key] = None
                if dots[-at] / math.sqrt(inside + sum(x for _, x in outside)) >= threshold - 1e-6:
                    digest = hashlib.sha256(" ".join(key).encode("utf-8", "surrogatepass")).digest()[:16]
                    memo[key] = {"s": digest, "license": vectors[-at][0], "dot": dots[-at], "inside": inside,
                                 "terms": [{"t": t, "w": x} for t, (_, x) in
                                           zip(term_hashes([w for w, _ in outside]), outside)]}
            return memo[key]

        cand_type = pa.list_(pa.struct([("s", pa.binary()), ("license", pa.string()), ("dot", pa.float64()),
                                        ("inside", pa.float64()), ("terms", pa.list_(pa.struct(
                                            [("t", pa.int64()), ("w", pa.float64())])))]))
        for batch in batches:
            text = _lower(batch.column(2))
            data, off = batch_bytes(text)
            found, open_ = [None] * batch.num_rows, [[]] * batch.num_rows
            for lo, _, counts, h in hashed_groups(data, off, ALNUM_WORDS):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                rows = np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(keys[at] == h), side="right"))
                for i in (rows + lo).tolist():
                    low = text[i].as_py()
                    hits = [best(w) for w in statements(low, half) if not heavy_set.isdisjoint(w)]
                    hits += [best(w) for w in joined(low, half, heavy_set)]
                    hits = {c["s"]: c for c in hits if c}.values()
                    # complete inside the vocabulary: scored here
                    good = [(-round(c["dot"] / math.sqrt(c["inside"]), 6), c["license"]) for c in hits if not c["terms"]]
                    found[i] = min((g for g in good if -g[0] >= threshold), default=None)
                    # what cannot beat it even at the smallest idf of the other terms need not be counted
                    floor = -found[i][0] if found[i] else 0.0
                    open_[i] = [c for c in hits if c["terms"] and
                                c["dot"] / math.sqrt(c["inside"] + sum(x["w"] for x in c["terms"])) >= floor - 1e-6]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f and f[1] for f in found], pa.string()),
                 pa.array([-f[0] if f else 0.0 for f in found], pa.float64()), pa.array(open_, cand_type)],
                ["id", "path", "license", "similarity", "open"])

    src = for_arrow(docs, F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"),
                      text_or_empty(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = stage(src.mapInArrow(run, f"id {kind}, path string, license string, similarity double, "
                                     "open array<struct<s:binary,license:string,dot:double,inside:double,"
                                     "terms:array<struct<t:bigint,w:double>>>>")
                    .withColumn("rid", F.monotonically_increasing_id()), "license-statements")
    each = rows.select("rid", F.explode("open").alias("c")).select("rid", "c.*")
    # every distinct bag once, then its outside terms with their documents
    bag = stage(each.groupBy("s").agg(F.first("license").alias("license"), F.first("dot").alias("dot"),
                                      F.first("inside").alias("inside"), F.first("terms").alias("terms")), "license-bags")
    if bag.isEmpty():
        return rows.drop("open", "rid")
    outside = bag.select("s", F.explode("terms").alias("x")).select("s", "x.*")
    wanted = stage(outside.select("t").distinct(), "license-terms")
    counts = stage(document_counts(docs, text_col, wanted).join(wanted, "t", "left_semi"), "license-counts")
    weight = F.log(F.lit(n + 1.0) / (F.col("n_t") + 1)) + 1
    norms = outside.join(counts, "t").groupBy("s").agg(F.sum(F.col("w") * weight * weight).alias("outside"))
    scored = (bag.join(norms, "s").select("s", F.col("license").alias("name"), F.round(
        F.col("dot") / F.sqrt(F.col("inside") + F.col("outside")), 6).alias("score")).where(F.col("score") >= threshold))
    scored = stage(scored, "license-scores")
    best_open = stage(each.select("rid", "s").join(scored, "s").groupBy("rid")
                          .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name").alias("n"))).alias("o")),
                      "license-best")
    both = F.least(F.when(F.col("license").isNotNull(), F.struct((-F.col("similarity")).alias("s"),
                                                                 F.col("license").alias("n"))), F.col("o"))
    return (rows.join(best_open, "rid", "left").withColumn("b", both)
                .select("id", "path", F.col("b.n").alias("license"),
                        F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("similarity")))


def license_scan(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text",
                 templates=TEMPLATES, threshold: float = 0.6, half: int = 24,
                 license_file: str = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$") -> DataFrame:
    """One row per document: ``id_col``, ``path``, ``license`` (null: none),
    ``basis`` (``own``, ``inherited`` or ``none``), ``similarity`` (own statement)
    and ``license_dir`` (directory it was inherited from)."""
    rows = stage(own_licenses(docs, id_col, path_col, text_col, templates, threshold, half), "license-rows")
    clean = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", "")
    rows = rows.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace(clean, "(^|/)[^/]*$", "")))
    declared = (rows.where(F.col("license").isNotNull() & F.col("path").rlike(license_file))
                    .groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license", "path")).alias("d"))
                    .select(F.col("dir").alias("license_dir"), F.col("d.license").alias("dir_license")))
    declared = stage(declared, "license-dirs")
    # every distinct directory with its ancestors, itself and the root included
    dirs = rows.where("dir IS NOT NULL AND license IS NULL").select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("license_dir")))).alias("a")) \
             .select("dir", "a.*")
    nearest = (up.join(declared, "license_dir").groupBy("dir")
                 .agg(F.max(F.struct("depth", "license_dir", "dir_license")).alias("x"))
                 .select("dir", "x.license_dir", "x.dir_license"))
    # read again from a table, so that the join below deals out both sides itself
    # and a directory with very many files can be split over tasks
    nearest = stage(nearest, "license-nearest")
    inherit = F.col("license").isNull()
    return rows.join(nearest, "dir", "left").select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "dir_license").alias("license"),
        F.when(~inherit, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "similarity", F.when(inherit, F.col("license_dir")).alias("license_dir"))
