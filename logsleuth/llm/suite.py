"""One registered query per operator, over its whole table, and DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import decontaminate, exact_dedup, filter_audit, hard_negatives, licenses, minhash, mixing, pii, quality, secret_scan, simhash, substring_dedup
from . import token_counts as tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def hex_sha256(col):
    return F.sha2(F.encode(col, "UTF-8"), 256)


# Target weights of the mix: twice the share for one source, half for another;
# sources without an entry share the weight of the rest.
WEIGHTS = {f"src{i}": 10 for i in range(20)} | {"src0": 20, "src7": 5}
BLOCK_ROWS = 16

# The recursive part is the definition itself: slot by slot, the released block
# with the earliest deadline among sources that still have rows.
_MIX_ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT unnest([{", ".join(f"'{s}'" for s in sorted(WEIGHTS))}, NULL]) AS mix_source,
         unnest([{", ".join(str(WEIGHTS[s]) for s in sorted(WEIGHTS))}, 1])::BIGINT AS w,
         unnest(range({len(WEIGHTS) + 1})) AS c),
d AS (SELECT doc_id, source, coalesce(w.c, {len(WEIGHTS)}) AS c, w.mix_source,
             row_number() OVER (PARTITION BY coalesce(w.c, {len(WEIGHTS)})
               ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 15))::BIGINT, doc_id) - 1 AS i
      FROM documents LEFT JOIN w ON source = w.mix_source),
b AS (SELECT c, count(*) AS n, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS nb FROM d GROUP BY c),
init AS (SELECT list(b.c ORDER BY lpad(b.c::VARCHAR, 4, '0')) AS cs,
                list(w.w ORDER BY lpad(b.c::VARCHAR, 4, '0')) AS ws,
                list(b.nb ORDER BY lpad(b.c::VARCHAR, 4, '0')) AS nbs
         FROM b JOIN w USING (c)),
sim AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS phase, 0::BIGINT AS t0, cs, ws, nbs,
         list_transform(cs, lambda x: 0::BIGINT) AS done, list_transform(cs, lambda x: 0::BIGINT) AS base,
         NULL::BIGINT AS c, NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS deadline
  FROM init
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN phase + 1 ELSE phase END, CASE WHEN ends THEN slot + 1 ELSE t0 END,
         cs, ws, nbs, done2, CASE WHEN ends THEN done2 ELSE base END,
         cs[k], done[k], t0 + (done[k] - base[k]) * total // ws[k],
         t0 + ((done[k] - base[k] + 1) * total + ws[k] - 1) // ws[k]
  FROM (SELECT *, list_transform(done, lambda x, i: CASE WHEN i = k THEN x + 1 ELSE x END) AS done2,
               done[k] + 1 = nbs[k] AS ends
        FROM (SELECT *, list_sort(list_transform(list_filter(range(1, len(cs) + 1), lambda i: done[i] < nbs[i]
                                 AND (done[i] - base[i]) * total // ws[i] <= slot - t0),
                           lambda i: {{'d': ((done[i] - base[i] + 1) * total + ws[i] - 1) // ws[i],
                                  's': cs[i]::VARCHAR, 'i': i}}))[1].i AS k
              FROM (SELECT *, list_sum(list_transform(range(1, len(cs) + 1),
                                 lambda i: CASE WHEN done[i] < nbs[i] THEN ws[i] ELSE 0 END))::BIGINT AS total
                    FROM sim WHERE list_sum(done) < list_sum(nbs))))),
slots AS (SELECT slot - 1 AS slot, c, block, release, deadline,
                 lag(phase) OVER (ORDER BY slot) AS phase FROM sim),
placed AS (SELECT d.doc_id, d.source, d.mix_source, s.block, s.phase, s.release, s.deadline, s.slot, d.i
           FROM d JOIN slots s ON s.c = d.c AND s.block = d.i // {BLOCK_ROWS})
SELECT doc_id, source, mix_source, block, phase, release, deadline, slot,
       row_number() OVER (ORDER BY slot, i) - 1 AS position
FROM placed
"""


@register("op1_mix_sources", _MIX_ORACLE)
def op1(spark, sf_dir):
    """Every document's place in a mix of the sources to target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS, rest_weight=1, block_rows=BLOCK_ROWS)


@register("op2_quality_classifier")
def op2(spark, sf_dir):
    """Quality score of every document by nearest-neighbour voting."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_pii_spans")
def op3(spark, sf_dir):
    """Personal data and the terms that disclose it in every document."""
    out = pii.pii_spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = pii.spans_text("spans", range(len(pii.BASE)))
    return out.select("doc_id", *[n(k) for k in pii.KINDS], hex_sha256(base).alias("base_sha256"),
                      pii.spans_text("spans").alias("spans"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_token_counts")
def op4(spark, sf_dir):
    """Tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


_SUBSTRING_ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
      FROM t, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
first AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s),
hit AS (SELECT g.doc_id, g.i FROM g JOIN first USING (s) WHERE first.d < g.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, unnest(range(13)) AS u(k)),
per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT t.doc_id, len(w) AS n, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS k
         FROM t LEFT JOIN per USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""


@register("op5_substring_dedup", _SUBSTRING_ORACLE)
def op5(spark, sf_dir):
    """Words of every document left after its copied passages are removed."""
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", hex_sha256("kept").alias("kept_sha256"))


@register("op6_secret_scan")
def op6(spark, sf_dir):
    """Secrets in every document and whose they are."""
    S = secret_scan
    out = S.secret_spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == S.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in S.KINDS],
                      hex_sha256(S.spans_text("spans", range(len(S.BASE)))).alias("base_sha256"),
                      S.spans_text("spans").alias("spans"))


@register("op7_benchmark_overlaps")
def op7(spark, sf_dir):
    """Documents that hold a benchmark passage, substitutions included."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size,
             first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""")
def op8(spark, sf_dir):
    """Every document with the equal one that stays."""
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@register("op9_simhash_groups")
def op9(spark, sf_dir):
    """Every document's fingerprint and near-duplicate group."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as a tree of files: source / language / file.  Every 50th id
    is a license file of its source or of its source and language."""
    name = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), "doc_id"))) \
            .when(F.col("doc_id") % 50 == 0, F.concat_ws("/", "source", "lang", F.concat(F.lit("LICENSE-"), "doc_id"))) \
            .otherwise(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))))
    return docs.withColumn("path", name)


@register("op10_license_scan")
def op10(spark, sf_dir):
    """License of every document, by its own statement or its directories."""
    return licenses.license_scan(document_paths(table(spark, sf_dir, "documents")), "path")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op11_minhash_groups", rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w
                          ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS shared
         FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 80 * (n1 + n2 - shared)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM g
          UNION SELECT d, b FROM reach JOIN link ON r = a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(r) AS component_id, g.doc_id = min(r) AS kept
FROM g JOIN reach ON g.doc_id = d GROUP BY g.doc_id, g.s
""")
def op11(spark, sf_dir):
    """Every document's shingle set size and near-duplicate group."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
      FROM v AS a, v AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
""")
def op12(spark, sf_dir):
    """Hard negatives of every 50th vector, with some labels shifted."""
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


@register("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
             regexp_matches(text, '[#$%&*|]'), doc_id > least] AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (l.quality) AS good, count(*) FILTER (l.toxic) AS toxic
      FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic
                        FROM labels GROUP BY doc_id) AS l USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq,
             list_aggregate(list_transform([a.i, b.i, c.i, d.i, e.i], lambda x: chr((64 + x)::INTEGER)), 'string_agg', '') AS filter_order
      FROM l AS a, l AS b, l AS c, l AS d, l AS e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
x AS (SELECT part, filter_order, s.i::INTEGER AS step, seq[s.i] AS f, fails[seq[s.i]] AS here,
             list_bool_or(list_transform(seq[1:s.i - 1], lambda k: fails[k])) IS TRUE AS earlier,
             len(list_filter(fails, lambda k: k)) AS n_fails, n, good, toxic
      FROM m, o, l AS s),
r AS (SELECT part, filter_order, step, f,
             coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
""")
def op13(spark, sf_dir):
    """What each of five filters removes per language under every order."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
