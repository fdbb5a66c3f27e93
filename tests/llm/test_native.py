"""Quality rules, mixing, sharding, URL filter and the draws they rest on."""

import re
from collections import Counter, defaultdict
from math import comb, cos, pi, sin

import pytest
from pyspark.sql import functions as F

from snarewatch.llm import common, hypergeometric, mixing, quality_rules, sharding, url_filter

MEDIUM = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c\r\nd\x0be\x0cf"), (5, "a b c\r\nd\x0be\x0cf"), (6, "# $ | x " * 9), (None, "lost id")]


def docs(spark, rows=ODD, source="s"):
    return spark.createDataFrame([(i, t, source, "extra") for i, t in rows], "doc_id bigint, text string, source string, size string")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_hypergeometric_draw_has_its_distribution(spark):
    lit = lambda n: F.lit(n).cast("bigint")
    x = hypergeometric.draw_hypergeometric(lit(60), lit(25), lit(12), common.unit_interval(F.lit(3), F.col("id")))
    seen = Counter(r.x for r in spark.range(20000).select(x.alias("x")).collect())
    for k in range(13):
        assert abs(seen[k] / 20000 - comb(25, k) * comb(35, 12 - k) / comb(60, 12)) < 0.015


@pytest.mark.parametrize("counts", [(5, 0, 1000, 300000, 7), (0, 0, 1), (3,)])
def test_multivariate_draw_keeps_its_margins(spark, counts):
    array = F.array(*[F.lit(n).cast("bigint") for n in counts])
    total = sum(counts)
    rows = spark.range(20).select((F.col("id") * total / 19).cast("bigint").alias("n")).select("n", hypergeometric.draw_multivariate(array, F.col("n"), F.lit(1), F.col("n")).alias("x")).collect()
    assert all(sum(r.x) == r.n and all(0 <= a <= b for a, b in zip(r.x, counts)) for r in rows)


def test_base_rules_equal_brute_force(spark):
    rows = ODD + [(9, "to be or not to be that is the question " * 3), (10, "x " * 8), (11, "x " * 9)]
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    both = docs(spark, rows).select("doc_id", "text").unionByName(table)
    none = spark.createDataFrame([], "doc_id bigint")
    for r in quality_rules.judge_quality(both, none).collect():
        n = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and r.kept == (not r.base_failed) and abs(r.llr) < 1e-9


def test_quality_tells_held_out_junk_from_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    judged = quality_rules.judge_quality(table, quality_rules.trusted_sample(fit))
    held = judged.join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").where("not base_failed")
    got = {r.quality: (r.n, r.kept) for r in held.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert got[1][1] >= 0.998 * got[1][0] and got[0][1] <= 0.15 * got[0][0]


def test_ratios_and_verdicts_equal_a_plain_model(spark):
    import math
    import struct

    import xxhash

    def hashed(value, seed=42):
        data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
        return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)))[0]

    q, buckets = quality_rules, 64
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trusted = q.trusted_sample(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    good = {r.doc_id for r in trusted.collect()}
    held = {d for d in good if hashed(d, hashed("held back")) % q.HELD_BACK == 0}

    def features(text):
        h1 = [hashed(w) for w in WORDS.findall(text or "")]
        return [h % buckets for h in h1 + [hashed(b, hashed(a)) for a, b in zip(h1, h1[1:])]]

    rows = {r.doc_id: features(r.text) for r in docs.collect()}
    raw, target = Counter(), Counter()
    for d, f in rows.items():
        raw.update(f)
        target.update(f if d in good - held else [])
    n_raw, n_target = raw.total(), target.total()
    ratio = {b: round(math.log((target[b] * n_raw / n + q.PRIOR) / (n_target + q.PRIOR)) * q.SCALE) for b, n in raw.items()}
    score = {d: sum(ratio[b] for b in f) / q.SCALE / (len(f) + q.PAD) for d, f in rows.items()}
    got = q.judge_quality(docs, trusted, buckets=buckets).collect()
    assert len(got) == len(rows) and all(abs(r.llr - score[r.doc_id]) < 1e-5 for r in got)
    level = [score[d] for d in held if len(rows[d]) >= 39]  # twenty words and their pairs
    bar = sum(level) / len(level) - q.MARGIN
    assert all(r.kept == (not r.base_failed and score[r.doc_id] >= bar) for r in got if abs(score[r.doc_id] - bar) > 1e-5) and level


def test_quality_of_nothing(spark):
    assert quality_rules.judge_quality(docs(spark, []).drop("size"), spark.createDataFrame([], "doc_id bigint")).count() == 0


def targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


def test_mix_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 7}" if i % 5 else None) for i in range(700)] + [(900, "only four words here", "tiny"), (901, None, "none"), (902, "", "s1")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(table).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want, taken = targets(sizes), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size and r.taken == len(r.shards) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 12 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(table.repartition(3)).collect()))


def test_a_long_document_leaves_no_gap(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.005 * r.target for r in by) and len(by) > 5


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(1, "w " * 40, "a")] * 6 + [(2, "v " * 40, "b")] * 2
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    want = targets({"a": 240, "b": 80})
    for source in "ab":
        assert abs(sum(r.taken for r in out if r.source == source) - want[source]) <= 40
    assert all(r.taken <= 3 * r.size for r in out)


def test_clashing_names_pass_through(spark):
    rows = [(i, f"text {i} of some ten words that say a little more than nothing at all here today", -7, "mine", 0.5, i) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, llr string, kept double, _words int")
    good = quality_rules.good_documents(table.selectExpr("doc_id", "concat(text, ' and so it goes on') as text", "n_words", "llr", "kept", "_words"), spark.createDataFrame([], "doc_id bigint"))
    assert good.columns == table.columns and {(r.n_words, r.llr, r.kept) for r in good.collect()} == {(-7, "mine", 0.5)}
    odd = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7)], "doc_id bigint, text string, source string, row int, shards int, _order int")
    mixed = mixing.mixed_documents(odd, mixing.mix_sources(odd))
    assert mixed.columns == odd.columns and {tuple(r) for r in mixed.collect()} == {(1, "a b c", "s", 5, 6, 7)}


def test_quotas_split_exactly(spark):
    quotas = {"a": 100, "b": 1, "c": 37, "d": 0}
    table = spark.createDataFrame(list(quotas.items()), "skey string, n bigint")
    rows = mixing.split_quotas(table, 7).collect()
    by_key, by_shard = Counter(), Counter()
    for r in rows:
        by_key[r.skey] += r.n
        by_shard[r.shard] += r.n
    assert all(by_key[k] == n for k, n in quotas.items()) and max(by_shard.values()) - min(by_shard.values()) <= 1
    first = {(r.skey, r.shard): r["first"] for r in rows}
    assert all(first[k, 0] == 0 for k in quotas)


@pytest.mark.parametrize("n", [0, 1, 39, 1003])
def test_shards_are_even_and_gapless(spark, n):
    out = sharding.shard_documents(docs(spark, [(i // 2, f"t{i % 9}") for i in range(n)])).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == n and max([0, *sizes.values()]) - (min(sizes.values()) if len(sizes) == 40 else 0) <= 1
    slots = defaultdict(set)
    for r in out:
        slots[r.shard].add(r.slot)
    assert all(slots[s] == set(range(k)) for s, k in sizes.items())


def test_shards_of_odd_rows(spark):
    out = {(r.doc_id, r.size, r.text_crc32) for r in sharding.shard_documents(docs(spark)).collect()}
    assert (1, 16, 0) in out and (4, 19, 2053932785) in out and len(out) == len(set(ODD))


def test_matrix_margins(spark):
    sizes = [3, 0, 50, 7, 1, 0, 0, 12, 9]
    table = spark.createDataFrame(list(enumerate(sizes)), "part int, n bigint")
    rows = sorted(sharding.communication_matrix(table, 5, n_parts=9).collect())
    assert [sum(r.counts) for r in rows] == sizes
    columns = [sum(c) for c in zip(*[r.counts for r in rows])]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(sizes)


def test_url_rules_and_reputation(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q", "example.net/en/"), (2, "http://a.example.net/de", "net/"), (3, "https://example.com/de/1", "example.com/de/"),
        (4, "https://notexample.com/de/1", None), (5, "https://x.org/fr/", "org/fr/"), (6, "https://x.org/frx", None), (7, None, None), (8, "no scheme", None), (9, "a://b://c/d#e", None),
    ]
    rows += [(100 + i, f"http://bad.com/{i}", None) for i in range(60)] + [(200 + i, f"http://good.com/{i}", None) for i in range(60)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)], "page_id bigint, bad int")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert {i: out[i].rule for i, _, _ in rows} == {i: rule for i, _, rule in rows}
    assert (out[1].host, out[1].path, out[1].verdict) == ("a.example.net", "/en/x", "allow") and out[2].verdict == "block"
    assert (out[7].host, out[7].path, out[8].host) == ("", "", "") and (out[9].host, out[9].path) == ("b:", "//c/d")
    assert out[100].verdict == "block" and out[200].verdict == "allow" and out[4].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.where("page_id = 4"), outcomes.limit(0)).collect()} == {"allow"}


def beta_quantile(alpha, beta, chance, steps=20_000):
    """By summing the density, with its peaks at the ends left out by substitution of the variable."""
    # x = sin^2(t) smooths both ends: dx = 2 sin cos dt
    total, sums = 0.0, []
    for i in range(steps):
        t = (i + 0.5) * pi / 2 / steps
        total += sin(t) ** (2 * alpha - 1) * cos(t) ** (2 * beta - 1)
        sums.append(total)
    at = next(i for i, s in enumerate(sums) if s >= chance * total)
    return sin((at + 0.5) * pi / 2 / steps) ** 2


@pytest.mark.parametrize(("alpha", "beta", "off"), [(60, 3, 0.002), (12, 10, 0.002), (5, 2, 0.005), (2, 8, 0.005), (1, 1, 0.02), (0.6, 4, 0.02)])
def test_posterior_bound_is_the_beta_quantile(spark, alpha, beta, off):
    low = spark.range(1).select(url_filter.lower_bound(F.lit(float(alpha)), F.lit(float(beta)))).first()[0]
    assert abs(low - beta_quantile(alpha, beta, 0.05)) < off


def test_reputation_equals_brute_force(spark):
    """Moments, three levels of shrinking, posterior and verdict, worked out in plain Python."""
    rates = {"a.x.co.uk": 9, "b.x.co.uk": 8, "y.co.uk": 1, "u@z.com:80": 0, "w.z.com": 5, "q.org": 3, "1.2.3.4": 2, "": 1, "new.x.co.uk": None}
    visits = [(h, int(i % 10 < r)) for h, r in rates.items() if r is not None for i in range(10 + 7 * len(h))] + [("new.x.co.uk", None)] * 3
    domain = {"a.x.co.uk": "x.co.uk", "b.x.co.uk": "x.co.uk", "new.x.co.uk": "x.co.uk", "y.co.uk": "y.co.uk", "u@z.com:80": "z.com", "w.z.com": "z.com", "q.org": "q.org", "1.2.3.4": "1.2.3.4", "": ""}
    suffix = {"x.co.uk": "co.uk", "y.co.uk": "co.uk", "z.com": "com", "q.org": "org", "1.2.3.4": "", "": ""}

    def tally(name):
        n, bad = Counter(), Counter()
        for host, b in visits:
            n[name(host)] += b is not None
            bad[name(host)] += b or 0
        return n, bad

    def weight(n, bad):
        seen = [k for k in n if n[k]]
        total, m = sum(n[k] for k in seen), sum(bad[k] for k in seen) / sum(n[k] for k in seen)
        if len(seen) < 2 or not 0 < m < 1:
            return 10.0
        spread = sum(n[k] * (bad[k] / n[k] - m) ** 2 for k in seen)
        room = m * (1 - m) * (total - sum(n[k] ** 2 for k in seen) / total - (len(seen) - 1))
        return 1 / min(max((spread - m * (1 - m) * (len(seen) - 1)) / room if room > 0 else 0.0, 0.002), 0.5) - 1

    hosts, domains, suffixes = tally(lambda h: h), tally(lambda h: domain[h]), tally(lambda h: suffix[domain[h]])
    whole = (sum(hosts[1].values()) + 1) / (sum(hosts[0].values()) + 2)
    shrink = lambda t, k, prior, w: (t[1][k] + prior * w) / (t[0][k] + w)
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(visits, "host string, bad int")).collect()}
    assert set(got) == set(rates)
    for h in rates:
        d = domain[h]
        prior = shrink(domains, d, shrink(suffixes, suffix[d], whole, weight(*suffixes)), weight(*domains))
        k = weight(*hosts)
        alpha, beta = hosts[1][h] + prior * k, hosts[0][h] - hosts[1][h] + (1 - prior) * k
        assert (got[h].n, got[h].n_bad) == (hosts[0][h], hosts[1][h])
        assert abs(got[h].prior - prior) < 1e-9 and abs(got[h].alpha - alpha) < 1e-9 and abs(got[h].beta - beta) < 1e-9
        assert abs(got[h].low - beta_quantile(alpha, beta, 0.05)) < 0.02


def test_outcomes_need_letters_and_an_article(spark):
    documents = spark.createDataFrame([(1, "123 456"), (2, "Alpha beta"), (3, "gamma 1"), (4, None), (5, "alphabeta")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 0, 1), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    pages = [(1, "<p>123</p>"), (2, "<article><h1>Title</h1><p>Alpha<br>be<b>ta</b> 7 &amp; 9</p></article><p>x</p>"), (3, "<article class=a>gam<i>ma</i>"), (4, None), (5, "<article>12</article>"), (6, "<articles>gamma</articles>")]
    out = url_filter.page_outcomes(spark.createDataFrame(pages, "page_id bigint, html string"), documents, labels)
    assert {(r.page_id, r.bad) for r in out.collect()} == {(2, 1), (3, 1)}
