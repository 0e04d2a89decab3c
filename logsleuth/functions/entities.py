"""Regex entity extraction as column expressions (F1–F5, PF5–PF7, T5–T7).

All work happens inside the row with ``regexp_extract_all``/``split`` and
higher-order functions, so extraction is a narrow projection: no shuffle, no
Python.  Matches are kept as an array of structs per text until a caller
explodes them.

Semantics kept on purpose:

- patterns are case-insensitive and Unicode-aware (``(?iU)``: ``\\w \\d \\b``
  follow Unicode like the original engine, not Java's ASCII default);
- matches are ordered by type, then pattern, then position;
- within one text only the first occurrence of a (type, id) is scored — a
  later occurrence with a better context is not looked at (T6);
- patterns are unanchored: ``i-…`` matches inside ``eni-…`` (T7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hof import first_of_group, let, running_starts

# Entity types in evaluation order and their patterns, in order.
ENTITY_TYPES = [
    "iam_role_arn",
    "iam_user_arn",
    "ip_address",
    "vpc_id",
    "subnet_id",
    "kms_key_id",
    "s3_bucket",
    "ec2_instance_id",
    "security_group_id",
]
ENTITY_PATTERNS = {
    "iam_role_arn": [
        r"arn:aws:iam::\d{12}:role/[\w+=,.@-]+",
        r"arn:aws:sts::\d{12}:assumed-role/[\w+=,.@-]+/[\w+=,.@-]+",
    ],
    "iam_user_arn": [
        r"arn:aws:iam::\d{12}:user/[\w+=,.@-]+",
    ],
    "ip_address": [
        r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    ],
    "vpc_id": [r"vpc-[0-9a-f]{8,17}"],
    "subnet_id": [r"subnet-[0-9a-f]{8,17}"],
    "kms_key_id": [
        r"arn:aws:kms:[\w-]+:\d{12}:key/[0-9a-f-]{36}",
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    ],
    "s3_bucket": [
        r"arn:aws:s3:::[\w.-]+",
        r"[\w.-]+\.s3\.amazonaws\.com",
        r"s3://[\w.-]+",
    ],
    "ec2_instance_id": [r"i-[0-9a-f]{8,17}"],
    "security_group_id": [r"sg-[0-9a-f]{8,17}"],
}
# Confidence rules.
BASE_CONFIDENCE = 0.7
CONTEXT_KEYWORDS = {
    "iam_role_arn": ["role", "user", "policy", "arn"],
    "ip_address": ["ip", "address", "source", "destination"],
}
SNIPPET_CHARS = 20
CONTEXT_CHARS = 50

JAVA_FLAGS = "(?iU)"

# Literal every match of a pattern contains (lower case); used only as a
# guard before running the regex on long texts.
REQUIRED_LITERALS = {
    ENTITY_PATTERNS["iam_role_arn"][0]: "arn:aws:iam::",
    ENTITY_PATTERNS["iam_role_arn"][1]: "arn:aws:sts::",
    ENTITY_PATTERNS["iam_user_arn"][0]: "arn:aws:iam::",
    ENTITY_PATTERNS["ip_address"][0]: ".",
    ENTITY_PATTERNS["ip_address"][1]: ":",
    ENTITY_PATTERNS["vpc_id"][0]: "vpc-",
    ENTITY_PATTERNS["subnet_id"][0]: "subnet-",
    ENTITY_PATTERNS["kms_key_id"][0]: "arn:aws:kms:",
    ENTITY_PATTERNS["kms_key_id"][1]: "-",
    ENTITY_PATTERNS["s3_bucket"][0]: "arn:aws:s3:::",
    ENTITY_PATTERNS["s3_bucket"][1]: ".s3.amazonaws.com",
    ENTITY_PATTERNS["s3_bucket"][2]: "s3://",
    ENTITY_PATTERNS["ec2_instance_id"][0]: "i-",
    ENTITY_PATTERNS["security_group_id"][0]: "sg-",
}
# Non-ASCII characters that match ASCII letters under Unicode case folding.
CASE_FOLD_FROM = "\u017f\u0131\u0130\u212a"
CASE_FOLD_TO = "siik"

ENTITY_STRUCT = ("struct<entity_type:string,entity_id:string,confidence:double,"
                 "context:string,source_field:string,ord:int>")


def is_valid_ipv4(c: Column) -> Column:
    """PF5: exactly 4 dot-separated parts, each an integer 0..255."""
    parts = F.split(c, r"\.", -1)
    return F.coalesce(
        (F.size(parts) == 4) & F.forall(
            parts, lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False))),
        F.lit(False))


def is_valid_account_id(c: Column) -> Column:
    """PF6: twelve ASCII digits."""
    return F.coalesce(c.rlike("^[0-9]{12}$"), F.lit(False))


def _found(text: Column, etype: str, pattern: str, ms: Column) -> Column:
    """The matches ``ms`` of one pattern with the lengths of the gaps before
    them; the text is only split where something matched."""
    none = F.array().cast("array<int>")
    return let(ms, lambda m: F.struct(
        F.lit(etype).alias("etype"), m.alias("m"),
        F.when(F.size(m) > 0, F.transform(F.slice(F.split(text, JAVA_FLAGS + pattern, -1), F.lit(1), F.size(m)),
                                          F.length)).otherwise(none).alias("g")))


def _guarded(text: Column, pattern: str, guard: Column) -> Column:
    """All non-overlapping matches; the pattern runs only where ``guard`` (the
    text folded by :func:`_fold`) holds the literal that every match has."""
    ms = F.regexp_extract_all(text, F.lit(JAVA_FLAGS + pattern), 0)
    lit = REQUIRED_LITERALS.get(pattern)
    return ms if lit is None else F.when(guard.contains(lit), ms).otherwise(F.array().cast("array<string>"))


def _scored(found: Column, text: Column, types, pieces: Column | None = None) -> Column:
    """Entities of all patterns' matches (array of :func:`_found`), in pattern and
    position order, with 0-based positions resolved; one expression for all
    patterns, so the plan does not grow with their number."""
    def at_start(x, m, at):
        return F.struct(x["etype"].alias("etype"), m.alias("id"), at.cast("int").alias("start"),
                        (at + F.length(m)).cast("int").alias("end"))

    def place(x):
        # a single match starts after its gap; several need running sums
        starts = running_starts(x["g"], F.transform(x["m"], F.length))
        return F.when(F.size(x["m"]) == 1, F.array(at_start(x, x["m"][0], x["g"][0]))).otherwise(
            F.zip_with(x["m"], starts, lambda m, at: at_start(x, m, at)))

    hits = F.flatten(F.transform(F.filter(found, lambda x: F.size(x["m"]) > 0), place))
    return F.transform(hits, lambda m: _score(m, text, types, pieces))


def _fold(text: Column) -> Column:
    """Lower case after mapping the characters that case-fold onto ASCII."""
    return F.lower(F.translate(text, CASE_FOLD_FROM, CASE_FOLD_TO))


PIECE_CHARS = 4096


def text_pieces(text: Column) -> Column:
    """The text cut every ``PIECE_CHARS`` characters.  ``substring`` walks a text
    from its start, so many snippets of a long text are taken from its pieces."""
    n = F.ceil(F.length(text) / PIECE_CHARS).cast("int")
    return F.when(n <= 1, F.array(text)).otherwise(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * PIECE_CHARS + 1, F.lit(PIECE_CHARS))))


def _snippet(text: Column, pieces: Column | None, lo: Column, n: Column) -> Column:
    """``n`` characters of the text from 0-based ``lo``."""
    if pieces is None:
        return F.substring(text, lo + 1, n)
    first = F.floor(lo / PIECE_CHARS).cast("int")
    last = F.floor((lo + n) / PIECE_CHARS).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substring(part, lo - first * PIECE_CHARS + 1, n)


def _confidence(m: Column, text: Column, types, pieces: Column | None = None) -> Column:
    """base by type and shape, halved under 3 chars, context boost, round 3."""
    etype, eid = m["etype"], m["id"]
    strong = {  # fixed values: shape rules and their confidence
        "iam_role_arn": (eid.startswith("arn:aws:"), 0.95), "vpc_id": (eid.startswith("vpc-"), 0.9),
        "s3_bucket": (F.length(eid) >= 3, 0.85), "kms_key_id": (F.length(eid) == 36, 0.9),
        "ec2_instance_id": (eid.startswith("i-"), 0.9), "ip_address": (is_valid_ipv4(eid), 0.95),
    }
    base = F.lit(BASE_CONFIDENCE)
    for t in reversed([t for t in strong if t in types]):
        base = F.when((etype == t) & strong[t][0], strong[t][1]).otherwise(base)
    base = F.when(F.length(eid) < 3, base * 0.5).otherwise(base)
    words = {t: CONTEXT_KEYWORDS[t] for t in types if t in CONTEXT_KEYWORDS}
    if words:
        lo = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))

        def hit(ctx):
            out = F.lit(False)
            for t, kws in words.items():
                some = F.lit(False)
                for k in kws:
                    some = some | ctx.contains(k)
                out = out | ((etype == t) & some)
            return out
        near = F.when(etype.isin(*words), let(
            F.lower(_snippet(text, pieces, lo, m["end"] + CONTEXT_CHARS - lo)), hit)).otherwise(F.lit(False))
        base = let(base, lambda b: F.when(near, F.least(F.lit(1.0), b + 0.05)).otherwise(b))
    return F.round(base, 3)


def _score(m: Column, text: Column, types, pieces: Column | None = None) -> Column:
    lo = F.greatest(m["start"] - SNIPPET_CHARS, F.lit(0))
    return F.struct(
        m["etype"].alias("entity_type"), m["id"].alias("entity_id"),
        _confidence(m, text, types, pieces).alias("confidence"),
        _snippet(text, pieces, lo, m["end"] + SNIPPET_CHARS - lo).alias("context"))


def extract_from_text(text: Column, entity_types=None, confidence_threshold: float = 0.7,
                      source_field: str | Column = "text_content") -> Column:
    """F1–F4 + PF7 for one text column → ``array<ENTITY_STRUCT>``.

    Only the requested types' patterns are evaluated (plan-time narrowing).
    ``ord`` numbers the kept entities in evaluation order.
    """
    types = ENTITY_TYPES if entity_types is None else [t for t in ENTITY_TYPES if t in entity_types]
    sf = F.lit(source_field) if isinstance(source_field, str) else source_field
    if not types:
        return F.array().cast(f"array<{ENTITY_STRUCT}>")

    def found(t):
        return let(_fold(t), lambda g: F.array(*[_found(t, etype, pat, _guarded(t, pat, g))
                                                 for etype in types for pat in ENTITY_PATTERNS[etype]]))
    return _finish(let(text, lambda t: let(found(t), lambda f: _scored(f, t, types))), confidence_threshold, sf)


def _first_occurrence(allm: Column) -> Column:
    """Keep the first occurrence of each (type, id), in order: sorted by key
    and place, first of each run, back in place order."""
    def by_key(rows):
        keyed = F.transform(rows, lambda x, i: F.struct(
            x["entity_type"].alias("entity_type"), x["entity_id"].alias("entity_id"), i.alias("i"), x.alias("x")))
        first = first_of_group(F.sort_array(keyed), ["entity_type", "entity_id"])
        back = F.sort_array(F.transform(first, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
        return F.transform(back, lambda y: y["x"])
    return let(allm, lambda rows: F.when(F.size(rows) > 1, by_key(rows)).otherwise(rows))


def _finish(allm: Column, confidence_threshold: float, sf: Column) -> Column:
    kept = F.filter(_first_occurrence(allm),
                    lambda x: x["confidence"] >= F.lit(confidence_threshold))
    out = F.transform(kept, lambda x, i: F.struct(
        x["entity_type"].alias("entity_type"), x["entity_id"].alias("entity_id"),
        x["confidence"].alias("confidence"), x["context"].alias("context"),
        sf.alias("source_field"), i.alias("ord")))
    return F.coalesce(out, F.array().cast(f"array<{ENTITY_STRUCT}>"))


def add_text_entities(df, text_col: str, out_col: str = "entities", entity_types=None,
                      confidence_threshold: float = 0.7, source_field="text_content"):
    """DataFrame form of :func:`extract_from_text` for long texts: each regex
    runs once per row in its own projection, and positions (a ``split``) are
    only computed for rows that matched."""
    types = ENTITY_TYPES if entity_types is None else [t for t in ENTITY_TYPES if t in entity_types]
    text = F.col(text_col)
    pats = [(t, p) for t in types for p in ENTITY_PATTERNS[t]]
    tmp = [f"__ms{i}" for i in range(len(pats))]
    # a pattern can only match where its literal occurs (case-insensitively):
    # lower-case once, after mapping the characters that case-fold onto ASCII
    out = df.withColumn("__guard", _fold(text))
    for name, (_, p) in zip(tmp, pats):
        out = out.withColumn(name, _guarded(text, p, F.col("__guard")))
    out = out.drop("__guard").withColumn("__pieces", text_pieces(text))
    sf = F.lit(source_field) if isinstance(source_field, str) else source_field
    if not pats:
        return df.withColumn(out_col, F.array().cast(f"array<{ENTITY_STRUCT}>"))
    found = F.array(*[_found(text, t, p, F.col(name)) for name, (t, p) in zip(tmp, pats)])
    out = out.withColumn("__found", found).drop(*tmp)
    out = out.withColumn("__allm", _scored(F.col("__found"), text, types, F.col("__pieces"))).drop("__found", "__pieces")
    return out.withColumn(out_col, _finish(F.col("__allm"), confidence_threshold, sf)).drop("__allm")


def boost(entities: Column, source_field: str) -> Column:
    """Set ``source_field`` and apply the ARN boost ``min(0.95, c + 0.1)``."""
    return F.transform(entities, lambda e: e.withField("source_field", F.lit(source_field))
                       .withField("confidence", F.least(F.lit(0.95), e["confidence"] + 0.1)))


def extract_from_arn(arn: Column, source_field: str = "userIdentity.arn") -> Column:
    """route by ARN shape, then boost confidence."""
    both = extract_from_text(arn, ["iam_role_arn", "iam_user_arn"])
    only = (F.when(arn.contains(":user/"), "iam_user_arn")
             .when(arn.contains(":role/") | arn.contains(":assumed-role/"), "iam_role_arn"))
    routed = F.transform(F.filter(both, lambda e: only.isNull() | (e["entity_type"] == only)),
                         lambda e, i: e.withField("ord", i))
    return F.when(arn.isNull(), F.array().cast(f"array<{ENTITY_STRUCT}>")).otherwise(
        boost(routed, source_field))


def with_source(entities: Column, source_field) -> Column:
    sf = F.lit(source_field) if isinstance(source_field, str) else source_field
    return F.transform(entities, lambda e: e.withField("source_field", sf))


def dedupe_entities(entities: Column) -> Column:
    """A6 inside one row: per (type, id) keep the highest confidence, first on
    ties, at the position of the key's first occurrence (sorts by key, so the
    cost of a long list stays near linear)."""
    def keyed(e, i, weight):
        return F.struct(e["entity_type"].alias("entity_type"), e["entity_id"].alias("entity_id"),
                        weight.alias("weight"), i.alias("i"), e.alias("e"))
    keys = ["entity_type", "entity_id"]

    # sort_array compares structs natively; array_sort runs a comparator expression
    def by_key(rows):
        # the same key order in both lists, so they pair up group by group
        place = first_of_group(F.sort_array(F.transform(rows, lambda e, i: keyed(e, i, F.lit(0.0)))), keys)
        best = first_of_group(F.sort_array(F.transform(rows, lambda e, i: keyed(e, i, -e["confidence"]))), keys)
        pairs = F.sort_array(F.zip_with(place, best, lambda p, b: F.struct(p["i"].alias("i"), b["e"].alias("e"))))
        return F.transform(pairs, lambda p: p["e"])

    def deduped(rows):
        ids = F.transform(rows, lambda e: F.struct(*[e[k].alias(k) for k in keys]))
        short = (F.size(rows) <= SHORT_LIST) & (F.size(F.array_distinct(ids)) == F.size(rows))
        return F.transform(F.when(short, rows).otherwise(by_key(rows)), lambda e, i: e.withField("ord", i))
    return let(entities, deduped)


# Lists up to this size are first tested for repeats, pair by pair.
SHORT_LIST = 8
