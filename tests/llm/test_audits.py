"""Filter audit, nearest neighbours and source divergence against brute force and SQL."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from snarewatch.llm import ann_search, filter_audit, queries, source_divergence
from snarewatch.llm.common import ensure_checkpoint_dir

SMALL = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ensure_checkpoint_dir(spark)
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    said = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in said.description]
    found = queries.queries()[name](spark, SMALL)
    assert sorted(found.columns) == sorted(names)
    want = sorted(tuple(plain(x) for x in r) for r in said.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in found.collect()) == want and want


# --- filter audit

LONG = " ".join(f"w{i}" for i in range(60))
AUDITED = [
    (1, "short text", "a"), (2, "short text", "a"), (2, "short text", "b"), (None, "short text", "a"), (None, None, None), (3, None, "a"), (4, "", None),
    (5, LONG, "a"), (6, LONG, "b"), (7, LONG + " #", "b"), (8, LONG.upper(), "b"), (9, "same " * 80, "a"), (10, "Same| " * 80, "a"), (11, LONG * 2000, "b"),
    (12, "ខ្មែរ " * 55, "c"), (12, LONG, "c"), (13, "a b", "c"),
]
LABELLED = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 0), (6, 1, 1), (8, None, 1), (9, 0, 0), (None, 1, 1), (99, 1, 1)]


def failed(rows):
    """Letters that each row fails, in plain Python."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        f = {"A"} if len(words) < 50 else set()
        f |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        same = [d for d, other, _ in rows if (other or "") == t and d is not None]
        f |= {"E"} if doc_id is not None and min(same) < doc_id else set()
        out.append(f)
    return out


def audited(rows, labels):
    fails, want = failed(rows), set()
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        steps, shares = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                all_fail = sum(letter in f for _, f in mine)
                alone = sum(f == {letter} for _, f in mine)
                shares[letter] += len(gone)
                steps.append(("".join(order), step + 1, letter, len(left), len(gone), all_fail - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        want |= {(part, *s[:2], *s[3:], shares[s[2]]) for s in steps}
    return want


def test_every_order_of_filters_is_counted(spark):
    ensure_checkpoint_dir(spark)
    docs = spark.createDataFrame([(*r, 1, "x") for r in AUDITED], "doc_id bigint, text string, source string, part int, filter string")
    labels = spark.createDataFrame([(*r, 5) for r in LABELLED], "doc_id bigint, quality int, toxic int, row int")
    got = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in got.drop("filter").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audited(AUDITED, LABELLED)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    clean = filter_audit.audit(docs.where("doc_id = 5"), labels.limit(0)).collect()
    assert len(clean) == 600 and {(r.kept, r.removed, r.shapley) for r in clean} == {(1, 0, 0)}


# --- source divergence


def diverging(rows, least_docs):
    """Rows of ``divergences`` in plain Python, with a dense table of terms and sources."""
    import re
    from collections import Counter, defaultdict

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = [t.translate(fold) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    want = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        sources = sorted(s for g, s in groups if g == lang)
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}
        whole = [sum(own[s][i] for s in sources) for i in range(len(kept))]
        p = lambda ns: [1 + 1_000_000_000 * (n + 2) // (sum(ns) + 2 * len(kept)) for n in ns]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p(own[s]), p(own[o]))), o.encode(), o) for o in sources if o != s]
            want |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            marks = [(-f(a, b), t.encode(), t) for a, b, n, t in zip(p(own[s]), p(whole), own[s], kept) if n > 0 and a > b]
            want |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(marks)[:10])}
    return want


@pytest.mark.parametrize("most,pairs", [(400_000, 1_000_000), (3, 1)])
def test_divergences_equal_a_dense_table(spark, monkeypatch, most, pairs):
    ensure_checkpoint_dir(spark)
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    monkeypatch.setattr(source_divergence.shared_terms, "__defaults__", (pairs,))
    monkeypatch.setattr(source_divergence, "FEW_GROUPS", most)
    monkeypatch.setattr(source_divergence, "FEW_SOURCES", pairs // 10_000)
    rows = [("Alpha beta BETA gamma", "en", "a"), ("alpha beta\x00beta delta9delta", "en", "b"), ("alpha ខ្មែរ ខ្មែរ beta", "en", "c"), ("ÄB äb äB beta", "en", None), (None, "en", "empty"), (None, None, None), ("one two", None, "x"), ("one one", "", "y")]
    rows += [("alpha beta gamma gamma epsilon", "en", "a")] * 5 + [("zeta " * 500 + "beta", "en", "b")] * 4 + [("lonely", "de", "a"), ("words", "de", "b"), ("", "fr", "a")] + [(f"t{i} u{i % 3} tie{'ab'[i % 2]}", "en", f"s{i % 4}") for i in range(20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = [tuple(r) for r in source_divergence.divergences(docs, least_docs=2, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == diverging(rows, 2)
    assert source_divergence.divergences(docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms():
    text = ("word " * 50 + "a" * 100 + ",B2c").encode()
    pieces, whole = ([t for part in source_divergence.terms_of(text, n) for t in part] for n in (7, 1 << 22))
    assert pieces == whole == [b"word"] * 50 + [b"a" * 100, b"b", b"c"]


# --- nearest neighbours


def nearest_of(rows, k):
    """Exact answers: (query_id, rank, vec_id, score) for rows whose id is divisible by 100."""
    usable = [(i, v, np.array(e, float)) for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = []
    for i, query, a in usable:
        if query % 100 == 0:
            far = sorted((float(np.sqrt(((b - a) ** 2).sum())), v) for j, v, b in usable if i != j and len(a) == len(b))
            out += [(query, n + 1, v, d) for n, (d, v) in enumerate(far[:k])]
    return out


def recall(got, want):
    """Share of wanted neighbours found, by distance, so that ties count alike."""
    by = {}
    for q, _, _, d in got:
        by.setdefault(q, []).append(d)
    return sum(d <= max(by.get(q, [-1.0])) for q, _, _, d in want) / len(want)


def test_every_neighbour_of_a_table_is_found(spark):
    ensure_checkpoint_dir(spark)
    folder = "/root/testdata/sf0.01"
    got = [tuple(r) for r in queries.op12_nearest_neighbours(spark, folder).select("query_id", "rank", "vec_id", "score").collect()]
    want = nearest_of([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()], 10)
    assert len(got) == len(want) and recall(got, want) >= 0.99
    truth = {(q, v): d for q, _, v, d in nearest_of([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()], 10**6)}
    assert all(truth[q, v] == d for q, _, v, d in got)


@pytest.mark.parametrize("block", [1 << 21, 100])
def test_odd_vectors_ties_and_few_rows(spark, monkeypatch, block):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(5)
    near = rng.standard_normal((60, 4))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near, 1)] + [(100 * i, [float(x) for x in v]) for i, v in enumerate(near[:3], 1)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(1100, [1.0, 2.0, 3.0, 4.0])] * 2
    rows += [(400, [5.0, 5.0]), (7, [5.0, 6.0]), (500, None), (8, []), (600, [0.0] * 4), (700, [float("nan"), 1.0, 1.0, 1.0]), (800, [1.0, None, 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1200, [9.0])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, length int, block int").repartition(3)
    got = ann_search.nearest(docs, F.col("vec_id") % 100 == 0, k=5, block=block).collect()
    want = nearest_of(rows, 5)
    assert sorted((r.query_id, r.rank, r.vec_id, f"{r.score:.9g}") for r in got) == sorted((q, n, v, f"{d:.9g}") for q, n, v, d in want)
    assert ann_search.nearest(docs.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann_search.nearest(docs.where("vec_id = 7"), F.col("vec_id") % 100 == 0).count() == 0
