"""op11 to op13 against plain Python, and their edge cases."""
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsleuth.llm import filter_audit, hard_negatives as H, minhash, suite

from conftest import SF  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- op11
def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain_groups(items):
    sets = defaultdict(list)
    for i, t in items:
        sets[shingle_set(t)].append(i)
    keys = [k for k in sets if k]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(keys)), 2):
        both = len(keys[a] & keys[b])
        if 100 * both >= 80 * (len(keys[a]) + len(keys[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for n, k in enumerate(keys):
        for i in sets[k]:
            least[find(n)] = min(least.get(find(n), i), i)
    where = {k: n for n, k in enumerate(keys)}
    return {i: (len(shingle_set(t)), least[find(where[shingle_set(t)])] if shingle_set(t) else i) for i, t in items}


def test_minhash_groups(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in suite.QUERIES["op11_minhash_groups"](spark, SF).collect()}
    want = plain_groups([(i, t) for i, t, *_ in rows])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_minhash_one_large_group(make):
    """Near copies from one text, few and many words changed: several components,
    members that only meet through others."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    items = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 8, 14])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        items.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(items)).collect()}
    want = plain_groups(items)
    assert got == want and len({c for _, c in want.values()}) > 5


def test_minhash_edges(make):
    long_text = " ".join(f"w{i % 5000}" for i in range(420_000))  # 2.3 MB
    items = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (7, "two one"),
             (8, long_text), (9, long_text + " end"), (None, "one two"), (None, "alone here"), (10, "a b c d e f"),
             (11, "a b c d e f g")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(items)).collect())
    n = len({(f"w{i % 5000}", f"w{(i + 1) % 5000}") for i in range(5000)})
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7),
                           (8, n, 8), (9, n + 1, 8), (None, 1, 6), (None, 1, None), (10, 5, 10), (11, 6, 10)])
    assert minhash.near_duplicates(make([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(make(items), percent=70)


def test_sketch_limit_holds():
    """Sets of exactly the lowest similarity stay within the limit of the sketch
    and meet in a band; the estimate falls with the similarity."""
    rnd = np.random.default_rng(3)
    limit = minhash.sketch_limit(80)
    assert 0 < minhash.sketch_limit(95) < limit < minhash.SKETCH_BITS // 2
    differing = rnd.binomial(minhash.SAMPLES, 0.2, 20_000)
    odd = [np.count_nonzero(np.bincount(rnd.integers(0, minhash.SKETCH_BITS, 2 * d), minlength=1) & 1) for d in differing]
    assert max(odd) <= limit
    assert (1 - 0.8 ** minhash.ROWS) ** minhash.BANDS < 4e-6


def test_minhash_sets_are_sent_once_a_cell(spark, monkeypatch):
    """A family of 60 sets with all its pairs: one copy of each set in one cell, not
    one a pair; with smaller blocks a few cells, and no pair in two of them."""
    pairs = spark.createDataFrame([(0, a, b) for a in range(60) for b in range(a)] + [(99, 100, 101)], "family long, a long, b long")
    for block, most in ((256, 1), (16, 8)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = [tuple(r) for r in minhash.dealt(pairs).collect()]
        assert sorted(x[1:] for x in got) == sorted((r["a"], r["b"]) for r in pairs.collect())
        cells = defaultdict(set)
        for cell, a, b in got:
            cells[a].add(cell)
            cells[b].add(cell)
        assert max(map(len, cells.values())) <= most


def test_minhash_confirms_exactly_and_shuffles_no_text(make, monkeypatch):
    """Small blocks and few count cells, ids that are null or come twice: the groups
    stay those of all pairs; the texts reach the full sets without an exchange."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COUNTS", 4096)
    rnd = random.Random(11)
    base, items = [f"w{rnd.randrange(300)}" for _ in range(100)], []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([3, 6, 9, 12])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(500)}"
        items.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(items)).collect()}
    want = plain_groups(items)
    assert got == want and len({c for _, c in want.values()}) > 5
    docs = make([(None, "a b c"), (7, "a b c"), (7, "d e"), (8, "f g"), (9, None)])
    ids = make([(None, ""), (7, "")]).selectExpr("doc_id AS id")
    sets = minhash.shingle_sets(docs, "doc_id", "text", 2, ids)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(r["shingles"]) for r in sets.collect()) == [1, 2, 2]


# ---- op12
def plain_negatives(rows, is_anchor, n_pos=5, n_neg=3):
    """rows of (id, label, integer vector)"""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for n, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = sorted((-score(v, w), j is None, j or 0, k) for m, (j, k, w) in enumerate(rows) if m != n)
        scored = [(-s, None if none else j, k) for s, none, j, k in scored]
        for s, j, _ in [x for x in scored if x[2] == label][:n_pos]:
            inside = [x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s][:n_neg]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(inside)]
    return Counter(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def got_negatives(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_hard_negatives_query(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        if r["label"] is None or r["embedding"] is None or not all(x is not None and np.isfinite(x) for x in r["embedding"]):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, [int(np.floor(256 * float(x))) for x in r["embedding"]]))
    want = plain_negatives(rows, lambda i: i % 50 == 0)
    assert want and got_negatives(suite.QUERIES["op12_hard_negatives"](spark, SF)) == want


def test_hard_negatives_edges(spark, monkeypatch):
    """Nulls, ties, repeated rows, lengths and many units."""
    rnd = random.Random(2)
    vec = lambda d: [rnd.choice([-0.5, 0.25, 1.0, 3.0]) for _ in range(d)]
    rows = [(i, rnd.choice(["a", "a", "b"]), vec(rnd.choice([3, 8, 11]))) for i in range(60)]
    rows += [rows[10], rows[10], rows[20], (None, "b", vec(8)), (None, "a", vec(8)), (61, "b", [])]
    bad = [(70, None, vec(3)), (71, "a", None), (72, "a", [1.0, None]), (73, "b", [float("nan")]), (80, "b", [float("inf")])]
    df = spark.createDataFrame(rows + bad, "vec_id long, label string, embedding array<float>")
    for c in ("id", "row", "chunk", "block", "planes", "score", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    monkeypatch.setattr(H, "CHUNK", 16)
    monkeypatch.setattr(H, "BLOCK", 3)
    ints = [(i, k, [int(np.floor(256 * x)) for x in v]) for i, k, v in rows]
    want = plain_negatives(ints, lambda i: i is not None and i % 10 == 0)
    assert want and got_negatives(H.hard_negatives(df, F.col("vec_id") % 10 == 0)) == want
    assert H.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert H.hard_negatives(df, F.lit(False)).count() == 0


def test_lookup_scores_exact():
    rnd = np.random.default_rng(1)
    for dims, size in [(1, 3), (8, 200), (13, 1 << 20), (64, 150)]:
        v, a = rnd.integers(-size, size, (50, dims)), rnd.integers(-size, size, (7, dims))
        assert (H.lookup_scores(H.subset_sums(a), H.bit_planes(v)) == v @ a.T).all()
    assert (H.lookup_scores(H.subset_sums(a), H.bit_planes(v * 0)) == 0).all()


# ---- op13
def plain_audit(docs, quality, toxic):
    """docs of (id, text, lang): simulates every order row by row."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        first = least.get(t)
        rows.append((i, lang or "", {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": first is not None and (i is None or i > first)}))
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if f[name]]
                redundant = sum(f[name] and any(f[x] for x in order[:step - 1]) for _, f in mine)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in mine)
                left = [x for x in left if not x[1][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone,
                                                   sum(i in quality for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got_audit(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"],
                                                       r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(out) == len(rows)
    return out


def marks(labels):
    rows = [tuple(r[:3]) for r in labels.collect()]
    return {i for i, q, _ in rows if q == 1 and i is not None}, {i for i, _, t in rows if t == 1 and i is not None}


def test_filter_audit(spark, rows):
    got = got_audit(suite.QUERIES["op13_filter_audit"](spark, SF))
    assert got == plain_audit([(i, t, lang) for i, t, lang, _ in rows], *marks(spark.read.parquet(f"{SF}/labels.parquet")))


def test_filter_audit_edges(spark, make):
    long_text = "word soup With a number 12345 " * 80_000  # 2.4 MB
    many = " ".join(f"w{i}" for i in range(120))
    items = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "\x0b\x0c \t\r\n", None, "s"), (4, many, "", "s"), (4, many, "", "s"),
             (5, many, "de", "s"), (None, many, "de", "s"), (None, "ONLY HERE #", "de", "s"), (None, "ONLY HERE #", "de", "s"),
             (6, long_text, "en", "s"), (7, long_text, "en", "s"), (8, "ÄÖÜ " * 100, "en", "s")]
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, None, 1), (5, 0, None), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = got_audit(filter_audit.audit_documents(make(items), labels))
    assert got == plain_audit([x[:3] for x in items], *marks(labels))
    assert filter_audit.audit_documents(make(items).limit(0), labels).count() == 0
    assert len(got_audit(filter_audit.audit_documents(make(items[:2]), labels.limit(0)))) == 600
