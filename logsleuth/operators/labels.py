"""Weak labelling for NER data (F8–F13, F23, F24, W9, W10, A19, A20, A23,
J13, J15, SC15).

Every example is a row; token and label sequences are parallel
``array<string>`` columns processed with higher-order functions inside the
row (no shuffle).  Corpus-level numbers (label distribution, token metrics,
quality score) are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hof import explode_rows, let, running_starts

# Label suggestion patterns (case-sensitive) by type, in order.
LABEL_TYPES = ["USER", "ROLE", "RESOURCE", "IP"]
SUGGESTION_PATTERNS = {
    "USER": [
        r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
        r"arn:aws:iam::[0-9]+:user/[^\s]+",
        r"arn:aws:sts::[0-9]+:assumed-role/[^/]+/[^\s]+",
    ],
    "ROLE": [
        r"arn:aws:iam::[0-9]+:role/[^\s]+",
        r"\b[A-Za-z][A-Za-z0-9]*Role\b",
    ],
    "RESOURCE": [
        r"arn:aws:[^:]+:[^:]*:[0-9]*:[^\s]+",
        r"\bi-[0-9a-f]{8,17}\b",
        r"\bvol-[0-9a-f]{8,17}\b",
        r"\bsg-[0-9a-f]{8,17}\b",
        r"\bs3://[^\s]+",
    ],
    "IP": [
        r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    ],
}
BIO_TAGS = ["O"] + [f"{p}-{t}" for t in LABEL_TYPES for p in ("B", "I")]
# NER label set of the span-based path (19 labels).
NER_ENTITY_TYPES = ["IAM_ROLE_ARN", "IAM_USER_ARN", "IP_ADDRESS", "VPC_ID", "SUBNET_ID",
                    "KMS_KEY_ID", "S3_BUCKET", "EC2_INSTANCE_ID", "SECURITY_GROUP_ID"]
NER_LABELS = ["O"] + [f"{p}-{t}" for t in NER_ENTITY_TYPES for p in ("B", "I")]

# A token is a run of letters/digits/@ . - _ : or one other non-space char.
TOKEN_PATTERN = r"(?U)[\p{L}\p{N}@._:-]+|\S"
MAX_ENTITY_TOKENS = 10
# Texts of the validation report.
LONG_ENTITY_WARNING = "Example %d: Very long entity (%d tokens)"


def tokenize(text: Column) -> Column:
    """the labelling tokenizer."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def suggest_labels(text: Column, label_types=None) -> Column:
    """F8: ``array<struct<entity, etype, reason>>`` by type, pattern,
    position; case-sensitive, no dedupe."""
    types = LABEL_TYPES if label_types is None else [t for t in LABEL_TYPES if t in label_types]
    parts = []
    for t in types:
        for p in SUGGESTION_PATTERNS[t]:
            reason = f"Pattern: {p[:30]}..."
            ms = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + p), 0)
            parts.append(F.transform(ms, _suggestion(t, reason)))
    return F.concat(*parts)


def _suggestion(etype: str, reason: str):
    def mk(m):
        return F.struct(m.alias("entity"), F.lit(etype).alias("etype"), F.lit(reason).alias("reason"))
    return mk


def auto_labels(tokens: Column, suggestions: Column) -> Column:
    """fold the suggestions over an all-'O' label array; each one tags
    the first run of tokens equal to its own tokens (B- then I-), later
    suggestions overwrite earlier ones.

    The token array travels inside the fold's accumulator: a lambda body
    never refers to an outer expression, which Catalyst could inline and
    re-evaluate per element."""
    sug = F.transform(suggestions, lambda s: F.struct(s["etype"].alias("etype"),
                                                      tokenize(s["entity"]).alias("et")))
    init = F.struct(tokens.alias("toks"), F.transform(tokens, lambda _: F.lit("O")).alias("labels"))

    def step(acc, s):
        toks, et = acc["toks"], s["et"]
        n, n_tok = F.size(et), F.size(toks)
        cands = F.filter(F.sequence(F.lit(0), F.greatest(n_tok - n, F.lit(0))),
                         lambda i: (F.try_element_at(toks, i + 1) == F.try_element_at(et, F.lit(1)))
                         & (i <= n_tok - n) & (F.slice(toks, i + 1, n) == et))

        def relabel(at):
            new = F.transform(acc["labels"], lambda lab, j: F.when(j == at, F.concat(F.lit("B-"), s["etype"]))
                              .when((j > at) & (j < at + n), F.concat(F.lit("I-"), s["etype"])).otherwise(lab))
            return F.struct(toks.alias("toks"),
                            F.when((n == 0) | at.isNull(), acc["labels"]).otherwise(new).alias("labels"))
        # the first match position is computed once per suggestion
        return let(F.try_element_at(cands, F.lit(1)), relabel)
    return F.aggregate(sug, init, step, lambda acc: acc["labels"])


def _tag(label: Column) -> Column:
    """The entity type of a B-/I- label: everything after the first two characters."""
    return label.substr(F.lit(3), F.length(label))


def bio_issues(labels: Column, tokens: Column | None = None, tags=None) -> Column:
    """Struct of per-example issue and warning counts: length mismatch,
    I- without a matching previous B-/I-, unknown labels (issues); entities
    longer than 10 tokens (one warning per token past 10), all-O (warnings)."""
    tags = BIO_TAGS if tags is None else tags
    prev = F.concat(F.array(F.lit("O")), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    pairs = F.arrays_zip(labels.alias("l"), prev.alias("p"))
    bad_i = F.size(F.filter(pairs, lambda x: x["l"].startswith("I-") & (
        (x["p"] != F.concat(F.lit("B-"), _tag(x["l"])))
        & ~x["p"].startswith(F.concat(F.lit("I-"), _tag(x["l"]))))))
    unknown = F.size(F.filter(labels, lambda lab: ~lab.isin(*tags)))
    mismatch = (F.when(tokens.isNotNull() & (F.size(tokens) != F.size(labels)), 1).otherwise(0)
                if tokens is not None else F.lit(0))
    run = F.aggregate(labels, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("warn")),
                      lambda acc, lab: F.when(lab.startswith("B-"), F.struct(
                          F.lit(1).alias("cur"), acc["warn"].alias("warn")))
                      .when(lab.startswith("I-"), F.struct(
                          (acc["cur"] + 1).alias("cur"),
                          (acc["warn"] + F.when(acc["cur"] + 1 > MAX_ENTITY_TOKENS, 1).otherwise(0)).alias("warn")))
                      .otherwise(F.struct(F.lit(0).alias("cur"), acc["warn"].alias("warn"))))
    all_o = F.when(F.forall(labels, lambda lab: lab == "O"), 1).otherwise(0)
    return F.struct((mismatch + bad_i + unknown).alias("issues"),
                    (run["warn"] + all_o).alias("warnings"),
                    mismatch.alias("length_mismatch"), bad_i.alias("invalid_i"),
                    unknown.alias("unknown_labels"), run["warn"].alias("long_entity"),
                    all_o.alias("all_o"))


def quality_report(examples: DataFrame, labels_col: str = "labels",
                   tokens_col: str | None = "tokens") -> DataFrame:
    """Totals and ``max(0, 100 - 10 issues - 2 warnings)``."""
    t = F.col(tokens_col) if tokens_col else None
    x = examples.select(bio_issues(F.col(labels_col), t).alias("q"))
    agg = x.agg(F.count(F.lit(1)).alias("total_examples"), F.coalesce(F.sum("q.issues"), F.lit(0)).alias("issues"),
                F.coalesce(F.sum("q.warnings"), F.lit(0)).alias("warnings"))
    return agg.withColumn("quality_score", F.greatest(
        F.lit(0), F.lit(100) - F.col("issues") * 10 - F.col("warnings") * 2))


def bio_spans(tokens: Column, labels: Column) -> Column:
    """``array<struct<etype, text>>`` of labelled entities; stray I-
    tags (no open entity) are ignored."""
    z = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    init = F.struct(F.lit(None).cast("string").alias("cur"),
                    F.array().cast("array<string>").alias("toks"),
                    F.array().cast("array<struct<etype:string,text:string>>").alias("out"))

    def close(acc):
        return F.when(acc["cur"].isNotNull() & (F.size(acc["toks"]) > 0), F.array_append(
            acc["out"], F.struct(acc["cur"].alias("etype"), F.concat_ws(" ", acc["toks"]).alias("text")))
        ).otherwise(acc["out"])

    def step(acc, x):
        return (F.when(x["l"].startswith("B-"), F.struct(
                    _tag(x["l"]).alias("cur"), F.array(x["t"]).alias("toks"),
                    close(acc).alias("out")))
                 .when(x["l"].startswith("I-") & acc["cur"].isNotNull(), F.struct(
                    acc["cur"].alias("cur"), F.array_append(acc["toks"], x["t"]).alias("toks"),
                    acc["out"].alias("out")))
                 .otherwise(F.struct(F.lit(None).cast("string").alias("cur"),
                                     F.array().cast("array<string>").alias("toks"),
                                     close(acc).alias("out"))))
    return F.aggregate(z, init, step, lambda acc: close(acc))


def label_distribution(examples: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Count and percent of every label over all tokens."""
    c = explode_rows(examples, labels_col, "label").groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    # the counts are one row per label of the tag set: their sum is the total,
    # so the texts are read and labelled once
    total = F.sum("count").over(Window.partitionBy())
    return c.select("label", "count", (F.col("count") * 100.0 / total).alias("pct"))


def labelling_progress(examples: DataFrame, target: int, labels_col: str = "labels") -> DataFrame:
    """Number of labelled examples, and their percent of ``target``."""
    done = examples.agg(F.count_if(F.size(labels_col) > 0).alias("labelled"))
    return done.withColumn("target", F.lit(target)).withColumn(
        "pct", F.when(F.lit(target) > 0, F.col("labelled") * 100.0 / target).otherwise(F.lit(0.0)))


def last_examples(examples: DataFrame, index_col: str = "index", k: int = 3) -> DataFrame:
    """SL7: the last ``k`` examples of the report."""
    return examples.orderBy(F.col(index_col).desc()).limit(k)


def words_with_offsets(text: Column, single_space: bool = False) -> Column:
    """Whitespace words with character offsets.  ``single_space=True``
    reproduces offsets that assume one space between words (T13)."""
    if single_space:
        words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")
        gaps = lambda ws: F.transform(ws, lambda _, i: F.when(i == 0, 0).otherwise(1))
        return let(words, lambda ws: _placed(ws, gaps(ws)))
    toks = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)
    segs = F.split(text, r"(?U)\S+", -1)
    lengths = lambda ws: F.transform(F.slice(segs, 1, F.size(ws)), F.length)
    return let(toks, lambda ws: _placed(ws, lengths(ws)))


def _placed(words: Column, gaps: Column) -> Column:
    """Words with their starts, as structs ``w, s``; running sums over chunks, so a
    very long text does not copy a growing array for each word."""
    empty = F.array().cast("array<struct<w:string,s:int>>")
    starts = running_starts(gaps, F.transform(words, F.length))
    return F.when(F.size(words) == 0, empty).otherwise(F.zip_with(
        words, starts, lambda w, s: F.struct(w.alias("w"), s.cast("int").alias("s"))))


def spans_to_bio(text: Column, spans: Column, single_space: bool = False) -> Column:
    """word labels from character spans: a word fully inside a span is
    labelled, B- when it starts at the span start, I- otherwise; the first
    span to claim a word wins."""
    words = words_with_offsets(text, single_space)

    def label(wd, sps):
        hits = F.filter(sps, lambda sp: (wd["s"] >= sp["start"])
                        & (wd["s"] + F.length(wd["w"]) <= sp["end"]))
        first = F.try_element_at(hits, F.lit(1))
        return F.when(first.isNull(), F.lit("O")).otherwise(F.concat(
            F.when(wd["s"] == first["start"], F.lit("B-")).otherwise(F.lit("I-")), first["label"]))
    # bind the span list once; each word then scans it as a lambda variable
    return let(spans, lambda sps: F.transform(words, lambda wd: label(wd, sps)))


def weak_spans(text: Column, arn: Column, ip: Column) -> Column:
    """first occurrence of the identity ARN (role if it contains
    'role', else user) and of the source IP inside ``text``."""
    a_pos = F.position(F.coalesce(arn, F.lit("\u0000")), text) - 1
    i_pos = F.position(F.coalesce(ip, F.lit("\u0000")), text) - 1
    arn_span = F.when(arn.isNotNull() & (arn != "") & (a_pos >= 0), F.struct(
        a_pos.alias("start"), (a_pos + F.length(arn)).alias("end"),
        F.when(arn.contains("role"), "IAM_ROLE_ARN").otherwise("IAM_USER_ARN").alias("label")))
    ip_span = F.when(ip.isNotNull() & (ip != "") & (i_pos >= 0), F.struct(
        i_pos.alias("start"), (i_pos + F.length(ip)).alias("end"), F.lit("IP_ADDRESS").alias("label")))
    return F.array_compact(F.array(arn_span, ip_span))


def align_labels(labels: Column, n_words: Column) -> Column:
    """pad with 'O' or truncate to ``n_words``."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit("O"), F.greatest(n_words, F.lit(0)))), 1, n_words)


def label_ids(labels: Column, vocabulary=None) -> Column:
    """Label → id by position in a fixed vocabulary (NER_LABELS)."""
    vocab = F.array(*[F.lit(v) for v in (NER_LABELS if vocabulary is None else vocabulary)])
    return F.transform(labels, lambda lab: (F.array_position(vocab, lab) - 1).cast("int"))


def vocabulary(examples: DataFrame, labels_col: str = "labels") -> DataFrame:
    """sorted distinct labels with dense ids (``label_to_id``)."""
    d = explode_rows(examples, labels_col, "label").distinct()
    return d.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("id"))


def token_metrics(pairs: DataFrame, label_col: str = "label", pred_col: str = "predicted",
                  ignore=("-100",)) -> DataFrame:
    """Support-weighted precision, recall, F1 and accuracy over token
    (label, predicted) pairs; zero division gives 0."""
    p = pairs.where(F.col(label_col).isNotNull() & ~F.col(label_col).cast("string").isin(*ignore))
    conf = p.groupBy(F.col(label_col).cast("string").alias("y"),
                     F.col(pred_col).cast("string").alias("yhat")).agg(F.count(F.lit(1)).alias("c"))
    sup = conf.groupBy(F.col("y").alias("cls")).agg(F.sum("c").alias("support"))
    prd = conf.groupBy(F.col("yhat").alias("cls")).agg(F.sum("c").alias("predicted"))
    tp = conf.where(F.col("y") == F.col("yhat")).select(F.col("y").alias("cls"), F.col("c").alias("tp"))
    per = sup.join(prd, "cls", "full").join(tp, "cls", "left").na.fill(0, ["support", "predicted", "tp"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("p", prec).withColumn("r", rec).withColumn(
        "f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
        .otherwise(0.0))
    tot = F.sum("support")
    return per.agg(
        (F.sum(F.col("p") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / tot).alias("f1"),
        (F.sum("tp") / tot).alias("accuracy"))


def split_assign(id_col: Column, seed: int = 42, train: int = 80, val: int = 10) -> Column:
    """stable seeded split by the MD5 of the id as text and the seed (no
    random state, identical under retries and across engines; ids of any type)."""
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % 100
    return F.when(h < train, "train").when(h < train + val, "validation").otherwise("test")


def upsert_examples(store: DataFrame, updates: DataFrame, key: str = "index", order: str | None = None) -> DataFrame:
    """Replace examples by key, append new ones.  Of several updates of one
    key the latest wins: the one with the greatest ``order``, a column of ``updates``
    that is not stored; ties, and updates without an order, go to the greatest row."""
    cols = [c for c in updates.columns if c != order]
    rank = F.struct(*([order] if order else []), F.to_json(F.struct(*cols)))
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_row")).select("_row.*")
    return store.join(latest.select(key), key, "left_anti").unionByName(latest.select(*cols))


def export_conll(examples: DataFrame, path: str, tokens_col: str = "tokens",
                 labels_col: str = "labels") -> None:
    """SC15: ``token<TAB>label`` lines, a blank line after each example."""
    body = F.concat(F.concat_ws("\n", F.transform(
        F.arrays_zip(F.col(tokens_col).alias("t"), F.col(labels_col).alias("l")),
        lambda x: F.concat_ws("\t", x["t"], x["l"]))), F.lit("\n"))
    examples.select(body.alias("value")).write.mode("overwrite").text(path)


def export_csv(examples: DataFrame, path: str, tokens_col: str = "tokens",
               labels_col: str = "labels") -> None:
    """SC15: CSV with pipe-joined token and label arrays."""
    out = examples.select(*[c for c in examples.columns if c not in (tokens_col, labels_col)],
                          F.concat_ws("|", tokens_col).alias(tokens_col),
                          F.concat_ws("|", labels_col).alias(labels_col))
    out.write.mode("overwrite").option("header", True).csv(path)


def export_json(examples: DataFrame, path: str) -> None:
    """SC15: JSON lines."""
    examples.write.mode("overwrite").json(path)


def top_suggestions(suggestions: Column, k: int = 10) -> Column:
    """SL6: the first ``k`` suggestions of a text."""
    return F.slice(suggestions, 1, k)


def validation_messages(examples: DataFrame, labels_col: str = "labels", tokens_col: str = "tokens",
                        index_col: str = "index", k: int = 10) -> DataFrame:
    """SL7 + W9: the first ``k`` issue and warning texts (by example, token)
    in the wording of the original report, plus their totals."""
    lab = F.col(labels_col)
    prev = F.concat(F.array(F.lit("O")), F.slice(lab, 1, F.greatest(F.size(lab) - 1, F.lit(0))))
    z = F.arrays_zip(lab.alias("l"), prev.alias("p"), F.sequence(F.lit(1), F.greatest(F.size(lab), F.lit(1)))
                     .alias("j"))
    ex = F.col(index_col) + 1
    bad_i = F.transform(F.filter(z, lambda x: x["l"].startswith("I-") & (
        x["p"] != F.concat(F.lit("B-"), _tag(x["l"])))
        & ~x["p"].startswith(F.concat(F.lit("I-"), _tag(x["l"])))),
        lambda x: F.format_string("Example %d, Token %d: Invalid I- tag without preceding B- tag", ex, x["j"]))
    unknown = F.transform(F.filter(z, lambda x: ~x["l"].isin(*BIO_TAGS)),
                          lambda x: F.format_string("Example %d, Token %d: Unrecognized label '%s'", ex,
                                                    x["j"], x["l"]))
    mism = F.when(F.size(tokens_col) != F.size(lab), F.array(F.format_string(
        "Example %d: Token count (%d) != Label count (%d)", ex, F.size(tokens_col), F.size(lab)))).otherwise(
        F.array().cast("array<string>"))
    allo = F.when(F.forall(lab, lambda x: x == "O"), F.array(F.format_string(
        "Example %d: No entities labeled (all O tags)", ex))).otherwise(F.array().cast("array<string>"))
    # fixed value: the text of the long-entity warning
    run = F.aggregate(z, F.struct(F.lit(0).alias("cur"), F.array().cast("array<string>").alias("out")),
                      lambda acc, x: F.when(x["l"].startswith("B-"), F.struct(F.lit(1).alias("cur"), acc["out"].alias("out")))
                      .when(x["l"].startswith("I-"), F.struct(
                          (acc["cur"] + 1).alias("cur"),
                          F.when(acc["cur"] + 1 > MAX_ENTITY_TOKENS, F.array_append(acc["out"], F.format_string(
                              LONG_ENTITY_WARNING, ex, acc["cur"] + 1))).otherwise(acc["out"]).alias("out")))
                      .otherwise(F.struct(F.lit(0).alias("cur"), acc["out"].alias("out"))), lambda acc: acc["out"])
    per = examples.select(index_col, F.concat(mism, bad_i, unknown).alias("iss"), F.concat(run, allo).alias("warn"))
    msgs = (explode_rows(per, "iss", "message", keep=[index_col], with_pos="_p")
            .withColumn("kind", F.lit("issue"))
            .unionByName(explode_rows(per, "warn", "message", keep=[index_col], with_pos="_p")
                         .withColumn("kind", F.lit("warning"))))
    # top-k per kind with TakeOrderedAndProject: partial top-k per partition, bounded merge
    first = [msgs.where(F.col("kind") == kind).orderBy(index_col, "_p").limit(k)
             for kind in ("issue", "warning")]
    return first[0].unionByName(first[1]).drop("_p")
