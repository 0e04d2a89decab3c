"""Results against plain Python versions on whole fixture tables."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from logsleuth.llm import decontaminate as D
from logsleuth.llm import exact_dedup, licenses, mixing, pii, quality, secret_scan, simhash, substring_dedup
from logsleuth.llm import suite, token_counts

from conftest import SF  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- op9
def plain_simhash(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_simhash_groups(spark, rows):
    fps = {i: plain_simhash(t) for i, t, *_ in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in suite.QUERIES["op9_simhash_groups"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}


@pytest.mark.parametrize("max_bits", [1, 2, 3, 5])
def test_links_exact(spark, max_bits):
    import random
    rnd = random.Random(max_bits)
    base = [rnd.getrandbits(64) for _ in range(12)]
    some = {b for b in base}
    for b in base:
        for n in range(1, 8):
            x = b
            for k in rnd.sample(range(64), n):
                x ^= 1 << k
            some.add(x)
    some |= {0, 1, 1 << 63, (1 << 64) - 1, 3 << 62}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df, max_bits).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits}
    assert got == want


def test_link_keys_are_not_broadcast(spark):
    """Few bytes of fingerprints are many of keys; Spark sizes the keys like the fingerprints."""
    from logsleuth.llm.common import stage
    fps = stage(spark.range(500).selectExpr("xxhash64(id) AS fp"), "some-fps")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_chain(spark):
    from logsleuth.llm.common import components
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# ---- op5
def plain_substring(rows, n=13):
    first = {}
    w = {i: words(t) for i, t, *_ in rows}
    for i in sorted(w):
        for k in range(len(w[i]) - n + 1):
            first.setdefault(tuple(w[i][k:k + n]), i)
    out = {}
    for i, ws in w.items():
        gone = set()
        for k in range(len(ws) - n + 1):
            if first[tuple(ws[k:k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = (len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone))
    return out


def test_substring(spark, docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == plain_substring(rows)


def test_substring_planted(spark, make):
    import random
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["of", "the"] * 60
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 120))] for _ in range(60)]
    for i in range(1, 60):  # pieces of other texts, many of them just 12 to 15 words
        for _ in range(rnd.randint(0, 3)):
            src = texts[rnd.randrange(60)]
            k, n = rnd.randrange(len(src) + 1), rnd.choice([12, 13, 14, 15, 40])
            at = rnd.randrange(len(texts[i]) + 1)
            texts[i][at:at] = src[k:k + n]
    texts += [["a"] * 40, ["a"] * 14, ["a"] * 12, ["a", "b"] * 20]
    items = [(i, rnd.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]
    out = substring_dedup.substring_dedup(make(items)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out} == plain_substring(items)
    for r in out:  # factors stand word for word at their place and cover exactly the removed words
        cover = set()
        for f in r["factors"]:
            mine = words(items[r["doc_id"]][1])[f["start"]:f["start"] + f["n_words"]]
            assert f["ref"] < r["doc_id"] and f["n_words"] >= 13
            assert mine == words(items[f["ref"]][1])[f["ref_start"]:f["ref_start"] + f["n_words"]]
            cover |= set(range(f["start"], f["start"] + f["n_words"]))
        assert len(cover) == r["n_removed"]
        # greedy: no factor lies in another, and none could be left out
        ends = [(f["start"], f["start"] + f["n_words"]) for f in r["factors"]]
        assert all(a < c and b < d for (a, b), (c, d) in zip(ends, ends[1:]))
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[2:]))


def test_substring_longest_factor(make):
    """A passage of a larger document stays one factor where smaller ones hold short stretches of it."""
    for k, whole in ((13, True), (24, True), (25, False)):
        long = [f"p{i}" for i in range(100)]
        texts = [["x"] * 3 + long[40:40 + k] + ["y"], ["z"] * 5 + long + ["z"], ["q"] * 7 + long + ["r"]]
        out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
        got = [tuple(f) for f in out[2]["factors"]]
        assert out[2]["n_removed"] == 100 and (got == [(7, 100, 1, 5)]) == whole, got


def test_substring_repeats_long(make):
    """Very many equal windows: the factors are as few as cover them, in texts above a megabyte too."""
    items = [(0, "a " * 300_000), (1, "b " + "a " * 600_000), (2, "c d")]
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(make(items)).collect()}
    assert [out[i]["n_removed"] for i in range(3)] == [0, 600_000, 0]
    assert len(out[1]["factors"]) <= 600_000 // 12 and out[1]["kept"] == "b"


# ---- op8
def test_exact_weak_digest_checks_bytes(make):
    from pyspark.sql import functions as F
    items = [(i, t) for i, t in enumerate(["a b", "ab", " a b ", "cd", "c d", "e", "", None, "ab  "])]
    strong = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(make(items)).collect()}
    weak = exact_dedup.exact_dedup(make(items), digest=lambda c: F.lit("same"))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in weak.collect()} == strong
    assert strong[1] == (2, 4, False) and strong[2][2] and strong[4] == (4, 2, True) and strong[7] == (6, 2, False)


def test_exact_state_crosses_batches(spark, docs):
    many = docs.repartition(7)
    a = {tuple(r) for r in exact_dedup.exact_dedup(many, max_files_per_trigger=2).drop("locator").collect()}
    b = {tuple(r) for r in exact_dedup.exact_dedup(docs).drop("locator").collect()}
    assert a == b


def test_exact_state_continues_over_calls(spark, make, tmp_path):
    """Later calls are judged against all rows so far; a repeated call counts once."""
    from pyspark.sql import functions as F
    root = str(tmp_path / "kept state")
    long = "x y " * 600_000
    first = [(1, "a b"), (2, "cd"), (3, None), (7, long)]
    second = [(4, "a  b "), (5, "c d"), (5, "c d"), (6, "new"), (8, long.strip()), (None, "")]

    def seen(items, **kw):
        out = exact_dedup.exact_dedup(make(items), root=root, **kw).collect()
        return sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in out)
    assert seen(first, batch="a") == [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (7, 7, 1, True)]
    want = [(0, 3, 2, False), (4, 4, 2, True), (5, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True), (8, 7, 2, False)]
    assert seen(second, batch="b") == want
    assert seen(second, batch="b") == want
    assert seen([], batch="c") == []

    # a weak digest: earlier texts come from their locators, in this call and the next
    root = str(tmp_path / "weak")
    weak = {"digest": lambda c: F.lit("same")}
    assert [r[1:] for r in seen(first, batch="a", **weak)] == [(1, 1, True), (2, 1, True), (3, 1, True), (7, 1, True)]
    assert seen(second, batch="b", **weak) == want
    assert seen([(9, "cd")], batch="c", **weak) == [(9, 5, 4, False)]


def test_exact_locator_finds_the_row(spark, docs):
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = exact_dedup.exact_dedup(docs.where("doc_id % 3 = 0"))
    place = exact_dedup.located(docs).select(exact_dedup.F.col("doc_id").alias("there"), "locator")
    assert out.join(place, "locator").where("doc_id = there").count() == out.count() > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == conf


# ---- op4
def test_token_counts(spark, rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=suite.tokenizer_path())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in suite.QUERIES["op4_token_counts"](spark, SF).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows}


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_safe_boundaries(name, rows):
    path = suite.tokenizer_path(name)
    counter = token_counts.Counter(open(path, "rb").read(), path.rpartition(".")[2])
    odd = ["a  b", " a b", "a b ", "it's a <s> </s> ▁ b ▁a b", "x▁ y z", "<|endoftext|> a b", "A b\n c d", "é a b",
           "1 2 a b 3", "a", "", "a b" * 50]
    texts = [t for _, t, *_ in rows][:120] + odd + [" ".join(odd * 3)]
    assert token_counts.count_texts(counter, texts, piece_chars=5, batch_bytes=400) == counter.lengths(texts)


# ---- op3
def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD_PII = ["a@b@c.d", "x@y.z@w.v u@v", "@a.b", "a.@b.c.", "1.2.3.4.5.6.7.8", "1.2.3.400 4.3.2.1", "0001.2.3.4", "1.2.3",
           "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-1234 x", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
           "café \U0001F600 me@h.example.com, +49 30 1234567", "a@b.c@d.e.f+1@g.h", "12345678901234567890", "é@b.cd"]


def test_pii_base(spark, rows):
    for t in ODD_PII + [t for _, t, *_ in rows]:
        assert pii.base_spans(t) == plain_pii(t), t[:80]
    got = {r["doc_id"]: r for r in suite.QUERIES["op3_pii_spans"](spark, SF).collect()}
    for i, t, *_ in rows:
        want = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in plain_pii(t))
        assert got[i]["base_sha256"] == sha(want)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == j for x in plain_pii(t)) for j in range(4)]
        assert want == ",".join(s for s in got[i]["spans"].split(",") if s.split(":")[0] in pii.BASE)


def test_pii_discloses_and_spares(spark, make):
    filler = ["the weather stays calm today", "prices moved up again here", "we went home by train then",
              "nothing else was said about it"]
    items = [(i, f"{filler[i % 4]} n{i} Moriarty writes from me@lair.example.com about plan{i}") for i in range(6)]
    items += [(10 + i, f"{filler[i % 4]} about q{i} and writes home from work") for i in range(40)]
    items += [(60 + i, "copied once Zaphod other@x.example.org end") for i in range(5)]  # one context only
    docs = make(items)
    spans = pii.pii_spans(docs)
    found = {r["doc_id"]: [(pii.KINDS[s["kind"]], dict((i, t) for i, t, *_ in items)[r["doc_id"]][s["start"]:s["end"]])
                           for s in r["spans"]] for r in spans.collect()}
    for i in range(6):
        assert ("remove", "Moriarty") in found[i] and ("email", "me@lair.example.com") in found[i]
        assert ("remove", "writes") not in found[i] and ("generalise", "about") not in found[i]
    assert all(not found[10 + i] for i in range(40))
    assert all([k for k, _ in found[60 + i]] == ["email"] for i in range(5))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, spans).collect()}
    assert "Moriarty" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == items[6][1]


def test_pii_counts_documents(make):
    """One long document that repeats an address near a common word is one document."""
    long = " ".join(f"a{i} b{i} common me@lair.example.com c{i} d{i} e{i} f{i} g{i} h{i} i{i}" for i in range(40))
    items = [(0, long)] + [(i, f"common word x{i} stays") for i in range(1, 20)] + [(i, f"other word x{i}") for i in range(20, 400)]
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_spans(make(items)).collect()}
    marked = {long[s["start"]:s["end"]] for s in spans[0] if s["kind"] >= len(pii.BASE)}
    assert "common" not in marked and sum(s["kind"] == 0 for s in spans[0]) == 40
    assert not spans[1] and not spans[300]


def test_pii_marks_everywhere(make):
    """A term of one address only is marked far from it and in documents without it."""
    pad = "we went home by train then and said nothing else about the weather today"
    items = [(i, f"{pad} Moriarty {pad} write v{i} to me@lair.example.com {pad} again n{i}") for i in range(4)]
    items += [(10, f"{pad} only MORIARTY here"), (11, "once Zaphod and then other@x.example.org end")]
    items += [(100 + i, f"{pad} write once and then again, the end q{i}") for i in range(1500)]
    text = dict(items)
    got = {r["doc_id"]: {(pii.KINDS[s["kind"]], text[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]}
           for r in pii.pii_spans(make(items)).collect()}
    marked = lambda i: {w for k, w in got[i] if k in ("generalise", "remove")}
    assert "Moriarty" in marked(0) and marked(10) == {"MORIARTY"} and not marked(11)  # one context is no evidence
    assert not marked(100) and "train" not in marked(0)


def plain_disclosing(texts, doubt=3.0, generalise=1.0, remove=0.5, reach=6):
    """The kind of each disclosing term (lower-cased), from counts over all texts."""
    import math

    n_t, n_et, contexts = Counter(), Counter(), defaultdict(set)
    for text in texts:
        spans = plain_pii(text or "")
        terms = [(m.start(), m.group().lower(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]
        n_t.update({w for _, w, _ in terms})
        free = [(a, w, b) for a, w, b in terms if len(w) > 1 and not any(a < e and s < b for s, _, e in spans)]
        for value in {(k, text[a:b]) for a, k, b in spans}:
            mine = []
            for s, k, e in spans:
                if (k, text[s:e]) == value:
                    near = [t for t in terms if t[2] <= s][-reach:] + [t for t in terms if t[0] >= e][:reach]
                    mine.append(tuple(text[a:b] for a, w, b in near if (a, w, b) in free))
            for w in {w for _, w, _ in free}:
                n_et[value, w] += 1
                contexts[value, w].add(min(mine))
    out = {}
    for (value, w), n in n_et.items():
        left = math.log2(n_t[w] / n) + math.log2(doubt) / len(contexts[value, w])
        if left <= generalise:
            out[w] = "remove" if left <= remove or out.get(w) == "remove" else "generalise"
    return out


def test_pii_verdicts_do_not_depend_on_the_table_size(spark, make):
    """The same documents among 1,000 and 30,000 others, against plain counts."""
    rnd = random.Random(4)
    pad = [f"p{i}" for i in range(300)]
    some = lambda: " ".join(rnd.choices(pad, k=8))
    items = [(i, f"{some()} Moriarty {some()} me@lair.example.com {some()} Baker{i % 2} {some()}") for i in range(5)]
    items += [(10 + i, f"{some()} Zaphod +49 30 1234567{i // 3} {some()} Moriarty{i}") for i in range(6)]
    items += [(20, f"one Solo and solo@ship.example.net {some()}"), (21, f"{some()} Moriarty again"), (22, "")]
    found = []
    for n in (1000, 30_000):
        rest = spark.range(n).selectExpr("id + 1000 AS doc_id", "concat('p', id % 300, ' p', id % 7, ' filler n', id) AS text",
                                         "'en' AS lang", "'src0' AS source", "0L AS n_chars")
        docs = make(items).select("doc_id", "text", "lang", "source", "n_chars").unionByName(rest)
        got = pii.pii_spans(docs).where("doc_id < 1000").collect()
        found.append({(r["doc_id"], pii.KINDS[s["kind"]], s["start"], s["end"]) for r in got for s in r["spans"]})
    assert found[0] == found[1]
    terms = plain_disclosing([t for _, t in items] + [f"p{i % 300} p{i % 7} filler n{i}" for i in range(1000)])
    text = dict(items)
    marked = {(i, k, text[i][a:b].lower()) for i, k, a, b in found[0] if k in ("generalise", "remove")}
    want = {(i, terms[w], w) for i, t in items for w in set(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t.lower())) if w in terms}
    assert marked == want and ("moriarty" in terms) and "solo" not in terms


def test_pii_entities_of_the_same_documents(make):
    """Many addresses of one document are one group, counted as each would be."""
    items = [(1, "alpha " + " ".join(f"u{i}@h.example.com" for i in range(300)) + " beta"), (2, "beta u1@h.example.com"), (3, "beta")]
    groups, pairs = pii.pair_counts(make(items), "text", 6, 1.0, 3.0)
    size = {r["g"]: (r["n_e"], r["n_entities"]) for r in groups.collect()}
    assert sorted(size.values()) == [(1, 299), (2, 1)]
    assert sorted((size[r["g"]][1], r["n_et"]) for r in pairs.collect()) == [(1, 1), (1, 2), (299, 1), (299, 1)]


# ---- op6
def plain_secrets(text):
    out = []
    for k, (p, g, n) in enumerate([(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
                                   (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return sorted(out)


def test_secrets_base(spark, rows, make):
    S = secret_scan
    odd = ["secret=token: abcdef1", "TOKEN : 'abc' token=\"abcdefg\"", "api_key=abcdef apikey:1234567", "AKIA" + "A" * 16,
           "xAKIA" + "B" * 15, "AKIAAKIA" + "C" * 14, "0123456789abcdef01234567", "\U0001F600 password = é passwd=hunter22",
           "token=" + "ab" * 15, " ".join(f"token=value{i}x" for i in range(700)), None, ""]
    items = [(i, t) for i, t in enumerate(odd + [t for _, t, *_ in rows])]
    for r in S.secret_spans(make(items)).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3]
        assert base == plain_secrets(items[r["doc_id"]][1] or ""), items[r["doc_id"]][1][:80]
    got = {r["doc_id"]: r for r in suite.QUERIES["op6_secret_scan"](spark, SF).collect()}
    for i, t, *_ in rows:
        assert got[i]["base_sha256"] == sha(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in plain_secrets(t)))


def test_secret_ownership(make):
    S = secret_scan
    live, copied = "q8Zr4TnW0xLk2VbY", "Xk29fLq8Rt5wZp1a"
    items = [(1, f"token = {live}", "en", "me"), (2, f"again token = {live}", "en", "me"),
             (3, f"password: {copied}", "en", "a"), (4, f"password: {copied}", "en", "b"), (5, "token = aaaaaaaa", "en", "c")]
    got = {r["doc_id"]: {S.KINDS[s["kind"]] for s in r["spans"]} for r in S.secret_spans(make(items)).collect()}
    assert got[1] == got[2] == {"assign", "live"} and got[3] == got[4] == {"assign", "example"}
    assert got[5] == {"assign", "unclear"}


# ---- op7
def plain_overlaps(rows, items, min_match=12):
    tok = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (t or "").lower())
    out = set()
    bench = [(i, tok(t)) for i, t in items]
    for d, t, *_ in rows:
        w = tok(t)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for item, b in bench:
            if len(b) < 8:
                continue
            matches = Counter(p - q for q, x in enumerate(b) for p in at.get(x, ()))
            for diag in [d for d, n in matches.items() if n >= min(min_match, len(b))]:
                eq = [0 <= diag + q < len(w) and w[diag + q] == x for q, x in enumerate(b)]
                best = max(((sum(eq[a:z]) * 3 - 2 * (z - a), a, z) for a in range(len(eq)) for z in range(a + 1, len(eq) + 1)
                            if sum(eq[a:z]) >= min(min_match, len(b))), default=(0, 0, 0))
                if best[0] > 0 and sum(eq[best[1]:best[2]]) >= 0.75 * (best[2] - best[1]):
                    out.add((d, item))
                    break
    return out


def test_overlaps(spark, rows):
    import random
    rnd = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted = []
    for n, (i, t) in enumerate(items):  # every 7th word replaced, case and marks changed
        w = t.split()
        some = [x.upper() + "," if k % 7 else "zzz" + str(n) for k, x in enumerate(w, 1)]
        planted.append((10_000 + n, " ".join(rnd.choice(rows)[1].split()[:80] + some)))
    all_rows = [(i, t) for i, t, *_ in rows] + planted
    docs = spark.createDataFrame(all_rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == plain_overlaps(all_rows, items)
    assert all((10_000 + n, i) in {(r["doc_id"], r["item_id"]) for r in found} for n, (i, t) in enumerate(items)
               if len(t.split()) >= 16)
    # a benchmark too large to broadcast; copies, null ids and repeated items are rows of their own
    docs = docs.union(spark.createDataFrame([(None, planted[0][1]), (None, planted[0][1]), (5, None), (6, "")], docs.schema))
    bench = bench.union(spark.createDataFrame([items[0], (7, ""), (8, None)], bench.schema))
    want, joined = (D.overlaps(docs, bench, block_bytes=n).collect() for n in (1 << 20, 0))
    rows_of = lambda x: sorted(map(repr, map(tuple, x)))
    assert rows_of(joined) == rows_of(want) and len(want) > len(found)
    assert D.overlaps(docs.limit(0), bench, block_bytes=0).count() == D.overlaps(docs, bench.limit(0)).count() == 0


def test_any_segment():
    import numpy as np
    rng = np.random.default_rng(7)
    for k in range(400):
        eq = rng.random(rng.integers(1, 60)) < rng.choice([0.5, 0.7, 0.8])
        need = int(rng.integers(1, 14))
        want = max((int(eq[a:z].sum()) for a in range(len(eq)) for z in range(a + 1, len(eq) + 1)
                    if eq[a:z].sum() >= max(need, 0.75 * (z - a))), default=None)
        got = D.any_segment(eq, need, 0.75)
        assert (got and got[2]) == want
        if got:
            a, z, n = got
            assert n == eq[a:z].sum() and n >= 0.75 * (z - a) and eq[a] and eq[z - 1]


def test_overlaps_short_and_broken(spark):
    """Short items at every allowed substitution, and exact runs whose whole is below the identity."""
    import math
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(7, 16)]
    items.append((99, " ".join(f"longword{k}" for k in range(162))))
    docs, want = [], set()
    for n, t in items[1:-1]:
        need = min(12, math.ceil(0.75 * n))
        for lost in (n - need, n - need + 1):
            for some in itertools.combinations(range(n), lost):
                i = len(docs)
                docs.append((i, "before it " + " ".join("zz" if k in some else w for k, w in enumerate(t.split())) + " after"))
                want |= {(i, n)} if lost == n - need else set()
    w = items[-1][1].split()
    docs.append((100_000, " ".join("zz" if 30 <= k % 44 else x for k, x in enumerate(w))))
    want.add((100_000, 99))
    found = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(r["similarity"] >= 0.75 for r in found)


# ---- op1
def test_mix_deviation(make):
    weights = {"a": 5, "b": 3, "c": 1}
    items = [(i, "x", "en", "abcd"[min(3, i % 7 // 2)]) for i in range(700)]
    out = mixing.mix(make(items), weights, rest_weight=2, block_rows=4).collect()
    assert sorted(r["position"] for r in out) == list(range(700))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    slots = {(r["slot"], r["phase"]): r["mix_source"] for r in out}
    w = {**weights, None: 2}
    for phase in {p for _, p in slots}:
        order = [slots[k] for k in sorted(slots) if k[1] == phase]
        active = {s for k, s in slots.items() if k[1] >= phase}
        served = dict.fromkeys(active, 0)
        for t, s in enumerate(order, 1):
            served[s] += 1
            for a in active:
                assert abs(served[a] - t * w[a] / sum(w[x] for x in active)) < 1


def test_mix_period_is_edf():
    for weights in ({"a": 1}, {"a": 7, "b": 3}, {"a": 1, "b": 1, "c": 97}, {chr(97 + i): i + 1 for i in range(20)}):
        table = mixing.period(weights)
        assert all(r <= t < d for _, _, r, d, t in table) and len(table) == sum(weights.values())


# ---- op2
def test_quality_held_out(spark):
    out = suite.QUERIES["op2_quality_classifier"](spark, SF.replace("0.001", "0.01"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet").collect()}
    got = out.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_vote_is_exact_neighbours():
    import numpy as np
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, (60, quality.TRIGRAMS + quality.SHAPES))
    model = quality.fit(counts[:40], rng.integers(0, 2, 40), axes=8)
    x = quality.unit(quality.weigh(counts[40:], model["idf"]) @ model["basis"])
    for row, s in zip(x, quality.vote(model, counts[40:], k=5, power=2)):
        cos = [(float(row @ v), y) for v, y in zip(model["vectors"], model["labels"])]
        top = sorted(cos, reverse=True)[:5]
        w = [max(c, 0) ** 2 for c, _ in top]
        assert abs(s - sum(a * y for a, (_, y) in zip(w, top)) / sum(w)) < 1e-4


# ---- op10
def test_license_own_against_all_statements(spark, docs, rows):
    got = {r["id"]: r["license"] for r in licenses.own_licenses(
        docs.withColumn("path", docs.source), "doc_id", "path", "text", licenses.TEMPLATES, 0.6, 24).collect()}
    import math
    bags = [(n, licenses.terms(t.lower())) for n, t in licenses.TEMPLATES]
    vocab = {w for _, b in bags for w in b}
    sets = [set(licenses.terms(t.lower())) for _, t, *_ in rows]
    N = len(rows)
    idf = {w: math.log((N + 1) / (sum(w in s for s in sets) + 1)) + 1 for w in vocab}
    vecs = [(n, licenses.vector(b, idf, math.log(N + 1) + 1)) for n, b in bags]
    for i, t, *_ in rows:  # without the trigger filter
        sims = [(round(sum(x * v.get(w, 0) for w, x in licenses.vector(s, idf, math.log(N + 1) + 1).items()), 6), n)
                for s in licenses.statements(t.lower(), 24) for n, v in vecs]
        top = max((s for s, _ in sims), default=0)
        assert (got[i] is not None) == (top >= 0.6)
        if top >= 0.6:
            assert got[i] in {n for s, n in sims if s == top}
    planted = {i for i, t, *_ in rows if re.search(r"licensed under|Released under the MIT", t, re.I)}
    assert {i for i, n in got.items() if n} == planted


def test_license_inheritance(make):
    items = [(1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "plain text"),
             (4, "plain text"), (5, "some words\nLicensed under CC BY-NC 4.0.\nmore"), (6, "plain"), (7, "plain"),
             (8, "no license here at all")]
    paths = {1: "LICENSE", 2: "/lib/x/LICENSE.txt", 3: "lib/a.txt", 4: "lib//x/y/z.txt", 5: "lib/x/own.txt", 6: None,
             7: "lib/x/f.txt", 8: "lib/x/y/LICENSE"}
    docs = make(items)
    from pyspark.sql import functions as F
    docs = docs.withColumn("path", F.element_at(F.create_map(*[F.lit(x) for kv in paths.items() for x in kv]), F.col("doc_id").cast("int")))
    got = {r["doc_id"]: (r["license"], r["basis"], r["license_dir"]) for r in licenses.license_scan(docs, "path").collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("MIT", "own", None), 3: ("Apache-2.0", "inherited", ""),
                   4: ("MIT", "inherited", "lib/x"), 5: ("CC-BY-NC-4.0", "own", None), 6: (None, "none", None),
                   7: ("MIT", "inherited", "lib/x"), 8: ("MIT", "inherited", "lib/x")}


def test_license_counts_all_terms(make):
    """An ordinary word beside a statement weighs by its documents, not as the rarest word."""
    common = "our here everyone reads about"
    items = [(i, f"{common} plain{i} things") for i in range(3000)]
    items += [(5000 + i, "Released under the MIT License") for i in range(150)]
    items += [(6000, "Released under the MIT License here our"), (6001, "released under the zork quux flarp glim brump wug"),
              (6002, "plain\nour here Released under the\nMIT License\nabout"),
              (6003, "Permission is hereby granted, free of\ncharge, to any person obtaining a\ncopy of this software and"
                     "\nassociated documentation files")]
    docs = make(items).selectExpr("*", "'a' AS path")
    got = {r["id"]: (r["license"], r["similarity"]) for r in licenses.own_licenses(
        docs, "doc_id", "path", "text", licenses.TEMPLATES, 0.6, 24).collect()}
    assert got[6000][0] == got[6002][0] == got[6003][0] == got[5000][0] == "MIT" and got[6001][0] is None
    assert got[0] == (None, 0.0) and len(got) == len(items)
    import math
    sets = [set(licenses.terms(t.lower())) for _, t in items]
    N = len(items)
    idf = lambda w: math.log((N + 1) / (sum(w in s for s in sets) + 1)) + 1
    mine = {w: idf(w) for w in licenses.terms(items[3150][1].lower())}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    template = {w: idf(w) for w in licenses.terms(licenses.TEMPLATES[0][1].lower())}
    cos = sum(mine[w] * x for w, x in template.items() if w in mine) / norm(mine) / norm(template)
    assert abs(got[6000][1] - cos) < 2e-6


# ---- long texts and recall
@pytest.mark.parametrize("tokens", [*range(8, 24), 24, 28])
def test_masks_hit_every_substitution(tokens):
    """All ways to substitute a quarter of an item's tokens (what the rule accepts)
    leave some mask whole."""
    import numpy as np

    n = tokens // 4
    subs = np.array(list(itertools.combinations(range(tokens), n))) if tokens < 28 else \
        np.argsort(np.random.default_rng(1).random((200_000, tokens)), axis=1)[:, :n]
    ok = np.ones((len(subs), tokens), bool)
    np.put_along_axis(ok, subs, False, 1)
    hit = np.zeros(len(subs), bool)
    for mask in (*D.MASKS, *D.SHORT_MASKS):
        at = [j for j, c in enumerate(mask) if c == "1"]
        for p in range(tokens - len(mask) + 1):
            hit |= ok[:, [p + j for j in at]].all(1)
    assert hit.mean() >= 0.9 and (tokens < 16 or hit.all())


def test_quality_counts_of_long_texts_as_in_one_pass():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(8)
    word = lambda: rnd.choice(["Ab", "x", "12", "end.", "...", "naïve", "ROCK", "a" * 300, " ", "\n\n"])
    text = " ".join(word() for _ in range(60_000)) + "z" * 1_500_000 + " tail tail Tail"
    assert len(text.encode()) > 2_300_000
    [(_, _, got)] = quality.term_counts(pa.array([text], pa.large_string()))
    data = np.frombuffer(text.encode(), np.uint8)
    want = np.zeros_like(got)
    quality._counts(data, np.array([0, len(data)]), want)
    assert (got == want).all()
