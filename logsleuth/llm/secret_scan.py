"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Base candidates are found by three fixed patterns.  Each candidate's value is
hashed and counted over the whole corpus by distinct owners and repositories: a
value that several owners have is a widely copied example, a value of one owner
that looks random is a live credential, the rest is unclear.  The verdicts are
added as spans beside the base spans.

Positions come from the pieces between the matches: a match starts where the
lengths of the pieces and matches before it end, so no text is searched twice.
The running sums go over chunks of ``CHUNK`` elements, so a text with very many
matches does not copy a growing array for each of them.

Edge cases: null text counts as empty; a null owner or repository is an owner
of its own; repeated rows give a row each and count as one owner; a value in
one row's text several times is one copy; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import let
from .common import stage, text_or_empty

# fixed values: kind, pattern, group of the value, least characters of it
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is a whole run
)
KINDS = (*(b[0] for b in BASE), "live", "example", "unclear")
CHUNK = 256
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def running_starts(gaps: Column, matches: Column) -> Column:
    """Start of each match, from the lengths of the gap before it and of the
    matches (arrays of the same size, at least one element)."""
    step = F.zip_with(gaps, matches, lambda g, m: F.struct(g.cast("long").alias("g"), m.cast("long").alias("m")))

    def fold(part, start):
        empty = F.expr("array()").cast("array<bigint>")
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"),
                                                   F.array_append(acc["out"], acc["at"] + x["g"]).alias("out")),
                           lambda acc: acc["out"])

    def whole(s):
        n = F.ceil(F.size(s) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(s, i * CHUNK + 1, CHUNK))
        return let(parts, by_part)

    def by_part(parts):
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["m"]))
        offsets = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"),
                                                F.expr("array()").cast("array<bigint>").alias("out")),
                              lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                                      F.array_append(acc["out"], acc["at"]).alias("out")),
                              lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: fold(p, o)))

    return let(step, whole)


def matches(text: Column, kind: int) -> Column:
    """Base spans of one kind: array of start, kind, end, value."""
    _, pattern, group, least = BASE[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m):
        values = m if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        starts = running_starts(F.transform(gaps, F.length), F.transform(m, F.length))
        rows = F.transform(F.arrays_zip(starts.alias("s"), m.alias("m"), values.alias("v")),
                           lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"),
                                              (x["s"] + F.length(x["m"])).cast("long").alias("end"),
                                              x["v"].alias("value")))
        return F.filter(rows, lambda x: F.length(x["value"]) >= least)

    none = F.expr("array()").cast(_SPAN)
    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def entropy(value: Column) -> Column:
    """Bits per character of a text of at least one character."""
    def bits(chars):
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0),
                           lambda acc, c: let(share(c), lambda p: acc - p * F.log2(p)))
    return let(F.split(value, ""), bits)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols=("source",),
                 repo_cols=("source", "lang"), example_owners: int = 2, example_repos: int = 3,
                 live_entropy: float = 3.0) -> DataFrame:
    """One row per document: ``id_col`` and ``spans``, an array of ``start``,
    ``kind`` (number in ``KINDS``), ``end`` (code points, ordered by start, kind),
    with the verdict spans over the values' matches."""
    owner = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in owner_cols])
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repo_cols])
    text = F.col("text")
    # cheap literal tests keep the patterns off texts that cannot match
    src = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"),
                      text_or_empty(text_col).alias("text"))
    none = F.expr("array()").cast(_SPAN)
    low = F.lower(text)
    may = [let(low, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in (
        "password", "passwd", "secret", "token", "apikey", "api_key")])), F.contains(text, F.lit("AKIA")), F.lit(True)]
    found = F.concat(*[F.when(may[k], matches(text, k)).otherwise(none) for k in range(len(BASE))])
    rows = stage(src.select("id", "owner", "repo", F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.sha2(s["value"], 256).alias("h"), entropy(s["value"]).alias("bits"))).alias("base"))
        .withColumn("rid", F.monotonically_increasing_id()), "secret-rows")
    each = F.transform("base", lambda s: F.struct(s["h"].alias("h"), s["bits"].alias("bits")))
    # one row per value, owner and repository before anything is counted by value
    seen = (rows.where(F.size("base") > 0).select("owner", "repo", F.explode(F.array_distinct(each)).alias("s"))
                .groupBy("s.h", "owner", "repo").agg(F.max("s.bits").alias("bits")))
    by_owner = seen.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("bits").alias("bits"))
    verdict = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"),
                                        F.max("bits").alias("bits"))
    code = (F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), KINDS.index("example"))
             .when(F.col("bits") >= live_entropy, KINDS.index("live")).otherwise(KINDS.index("unclear")))
    verdict = stage(verdict.select("h", code.alias("kind"), "owners", "repos"), "secret-verdicts")
    more = (rows.where(F.size("base") > 0).select("rid", F.explode("base").alias("s"))
                .select("rid", "s.start", "s.end", "s.h").join(verdict, "h")
                .groupBy("rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                  s["end"].alias("end")))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    return rows.join(more, "rid", "left").select(
        F.col("id").alias(id_col),
        F.array_sort(F.concat(base.cast(kind), F.coalesce(F.col("more").cast(kind), F.expr("array()").cast(kind))))
         .alias("spans"))


def spans_text(spans: Column, kinds=None) -> Column:
    """``kind:start:end`` joined by commas, of the given kind numbers."""
    some = F.filter(spans, lambda s: s["kind"].isin(list(kinds))) if kinds is not None else spans
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
