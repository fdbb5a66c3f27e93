"""PII, BPE, embeddings, HTML, Jaccard and chat operators against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snarewatch.llm import bpe, chat_format, embedding_dedup, html_extract, jaccard_join, pii

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- personal data


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("a@.+-1234567890 ()%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


def test_other_spans_and_masks():
    text = "GB82 WEST 1234 5698 7654 32, at 12 Old Mill Street; account no: 12345678, token = \"ab12cd34ef\" mail a@b.co"
    assert [s[0] for s in pii.find_spans(text)] == ["email", "account", "account", "address", "secret"]
    assert pii.mask("x a@b.co y", pii.find_spans("x a@b.co y")) == "x <email> y"
    assert pii.mask("ab", [("card", 0, 2), ("phone", 1, 2)]) == "<card>" and pii.find_spans("") == []
    assert pii.find_spans("the password policy and an account of streets") == []


@pytest.mark.parametrize("piece", ["-----BEGIN RSA PRIVATE KEY-----\n", "+1((( ", "a@", "1.1.", " street", "password=", "Ab "])
def test_personal_data_takes_linear_time(piece):
    start = time.perf_counter()
    pii.find_spans(piece * (200_000 // len(piece)))
    assert time.perf_counter() - start < 3


def test_key_blocks_and_long_street_names():
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    text = f"{foot} {head}a{head}b{foot} x {head}c{foot} {head} open"
    want = [m.span() for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", text, re.S)]
    assert [s[1:] for s in pii.find_spans(text) if s[0] == "secret"] == want and len(want) == 2
    name = "L" + "o" * 200
    assert pii.find_spans(f"at 7 {name} Street") == [("address", 3, 3 + 2 + len(name) + 7)]
    assert pii.find_spans("123456 Oak Road, 12345 A Street, 7 Xx Ab Cd Ef Gh Lane") == []


def test_personal_data_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "+1 (980) 555-6268; 1.2.3.4", 7), (3, "+1 (980) 555-6268; 1.2.3.4", 7)], "doc_id bigint, text string, spans int")
    out = sorted(pii.span_digests(pii.personal_data(rows)).collect())
    assert [(r.doc_id, r.n_phone, r.n_ip) for r in out] == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    assert out[0].base_sha256 == hashlib.sha256(b"").hexdigest() and out[2].spans == "ip:19:26,phone:0:17"
    assert [r.text for r in pii.mask_documents(rows).orderBy("doc_id").collect()] == [None, "", "<phone>; <ip>", "<phone>; <ip>"]
    assert pii.personal_data(rows.limit(0)).count() == 0


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_lexicon_is_minimal_and_exact(vocabulary, tmp_path):
    words = [a + b for a in ("walk", "talk", "stalk", "é") for b in ("", "s", "ed", "ing")]
    entries = {w.encode(): vocabulary.merge(w.encode()) for w in words}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(path))
    assert {w: lexicon.get(w) for w in entries} == entries
    assert lexicon.get(b"wal") is None and lexicon.get(b"walkx") is None and lexicon.get(b"") is None
    assert len(lexicon.first) - 1 < 20  # suffixes are shared: 16 words of 60 letters
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get(b"a") is None


def test_ids_equal_the_library(vocabulary):
    library = Tokenizer.from_file(PATH)
    random.seed(4)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 3000, " \n\n  x", "don't I'LL", "日本 🙂\u200b\x85\x1c", "١٢ ½ x²", "the end,\nnext line. "]
    texts += ["".join(random.choice("ab cd\n\t'.,é日🙂09 \u00a0") for _ in range(random.randint(1, 80))) for _ in range(1500)]
    encoder = bpe.Encoder(vocabulary, None)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids and vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memo_that_overflows_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    text = " ".join(f"word{i}x plain{chr(97 + i % 26)}" for i in range(200))
    assert bpe.Encoder(vocabulary, None).encode(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_round_trip_over_a_table(spark):
    rows = [(1, None), (2, ""), (3, "hello hello hello world"), (3, "hello hello hello world"), (4, "<|endoftext|>\n é")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    names = bpe.ship_lexicon(table, PATH)
    assert bpe.frequent_words(table) == ["endoftext", "hello", "world"] or "hello" in bpe.frequent_words(table)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    library = Tokenizer.from_file(PATH)
    want = sorted((i, len(e := library.encode(t or "", add_special_tokens=False).ids), digest(",".join(map(str, e))), digest(t or "")) for i, t in rows)
    assert sorted(map(tuple, bpe.round_trip(table, names).collect())) == want
    decoded = bpe.decode_documents(bpe.encode_documents(table, names), names)
    assert sorted((r.doc_id, r.text) for r in decoded.collect()) == sorted((i, t or "") for i, t in rows)


# --- embeddings


def brute_links(rows, threshold):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, v, a), (j, w, b) in itertools.combinations(good, 2):
        if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
            links[i] += 1
            links[j] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (links[i], root(i), root(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + rng.standard_normal(16) * 0.22).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, centres[0].tolist(), 0) for i in range(30)] + [(400, (centres[0] * 7).tolist(), 0), (401, centres[0].tolist(), None)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [1.0, None] * 8, 0), (504, [float("inf")] * 16, 0), (505, [], 0), (506, [1.0] * 4, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == brute_links(rows, 0.93)


def test_embedding_links_just_above_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b *= np.sqrt(1 - 0.9301**2) / np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.9301 * a + b).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embedding_dedup.near_duplicates(table).where("n_links > 0 and component_id = vec_id - vec_id % 2").count()
    assert found == len(rows)


@pytest.mark.parametrize(("bits", "tables"), [(4, 13), (7, 22), (18, 109), (30, 525)])
def test_codes_of_linked_vectors_seldom_differ_too_much(bits, tables):
    covered, most = embedding_dedup.code_plan(bits, tables, 0.93)
    n = covered * bits
    assert covered <= tables and n <= max(bits, embedding_dedup.CODE) and most < n
    signs = np.random.default_rng(1).random((100_000, n)) < np.arccos(0.93) / np.pi
    assert (signs.sum(axis=1) > most).sum() <= 3


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


# --- HTML


def test_article_is_read_by_structure():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><p>Site</p></header><nav>menu<ul><li>a<li>b</ul></nav>
    <div id="cookie-notice">We use <b>cookies</b></div><main><article><h1>Real &amp; title</h1><p>One
     two<br>three<p>Four <span class="ad">BUY</span> five<div class="ads"><p>buy <div>now</div></div><form><input> Name</form><blockquote>Quote</blockquote>
    <section class="comments"><article class="comment"><p>nice</p></article></section><p class=ad>ad text<p>Six &lt;b&gt; &nbsp; &#233;</article></main>
    <aside>side</aside><footer>foot</footer><script>if(a<b){document.write("<p>x</p>")}</script></body></html>"""
    assert html_extract.blocks_of(page) == (["Real & title", "One two three", "Four five", "Quote", "Six <b> é"], True)
    assert html_extract.blocks_of("") == ([], False) and html_extract.blocks_of("<p>a<p>b<!-- c") == (["a", "b"], False)
    assert html_extract.blocks_of("x < y and z > w")[0] == ["x < y and z > w"]


@pytest.mark.parametrize("page,want", [
    ('<div class="content no-sidebar"><article><p>Story one</p></article></div>', ["Story one"]), ('<div class="post-content comments-closed"><p>Story</p></div>', ["Story"]),
    ('<div class="site hidden-xs"><main><p>Story</p></main></div>', ["Story"]), ('<div class="search-results-page"><p>Story</p></div>', ["Story"]),
    ('<article><p>a</p><div class="share-price">12</div></article>', ["a", "12"]), ('<div class="sidebar"><p>before</p><article><p>Story</p></article></div>', ["Story"]),
    (f'<main><p>One</p><form id=aspnetForm><h1>Title</h1><p>{"word " * 60}</p><p>end</p></form></main>', ["One", "Title", ("word " * 60).strip(), "end"]),
    ('<form><p>Your name <input></p><p>Your mail</p></form><p>Story</p>', ["Story"]), ('<div class="comments-area"><article class="comment-body"><p>hi</p></article></div><p>Story</p>', ["Story"]),
    ('<div class="site-footer">foot</div><div class="post-comments"><p>hi</p></div><div class="ad-slot-2">buy</div><p>Story</p>', ["Story"]), ('<aside><article><p>teaser</p></article></aside><p>Story</p>', ["Story"]),
])
def test_a_name_marks_a_frame_as_a_whole_and_frames_hold_no_article(page, want):
    assert html_extract.blocks_of(page)[0] == want


def test_host_boilerplate_goes_where_no_element_names_the_text(spark):
    frame = "<div>Home About our great shop today</div>"
    rows = [(i, f"http://h.example/{i}", f"{frame}<div>Story number {i} tells of x{i} and y{i}</div><div>All rights reserved by us</div>") for i in range(5)]
    rows += [(7, "http://h.example/7", None), (8, None, ""), (9, "http://h.example/9", "<article><p>Kept as it is</p></article>"), (10, "http://h.example/9", "<article><p>Kept as it is</p></article>")]
    rows += [(20, "http://copy.example/a", "<p>one copied page of some words</p>"), (21, "http://copy.example/b", "<p>one copied page of some words</p>")]
    out = {r.page_id: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))).collect()}
    assert out[3].text == "Story number 3 tells of x3 and y3" and out[3].n_chars == len(out[3].text)
    assert (out[7].text, out[8].text, out[9].text, out[10].text) == ("", "", "Kept as it is", "Kept as it is")
    assert out[20].text == out[21].text == "one copied page of some words" and len(out) == len(rows)


def test_short_phrases_stay_and_long_runs_are_counted_over_the_whole_host(spark):
    """Sentences keep phrases that two pages share; parts of a host give no other text than the host."""
    notice = "this site is run by a small society of friends and gives no warranty at all"
    rows = [(i, f"http://h.example/{i}", f"<p>Tale{i} was told at the end of the day{i} by man{i}. {notice if i % 5 == 0 else ''}</p>") for i in range(40)]
    rows += [(100, "http://h.example/q", f"<p>Alone x {' '.join(f'q{k}' for k in range(14))} once</p>"), (101, "http://h.example/r", f"<p>Other y {' '.join(f'q{k}' for k in range(14))} again</p>")]
    out = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)).collect()}
    for i in range(40):
        assert out[i] == f"Tale{i} was told at the end of the day{i} by man{i}."
    assert out[100] == f"Alone x {' '.join(f'q{k}' for k in range(14))} once"

    def brute(pages):
        split = [[b.split() for b in p] for p in pages]
        found = {}
        for i, p in enumerate(split):
            for b in p:
                run = min(len(b), html_extract.LONG_RUN)
                for k in range(len(b) - run + 1 if run >= html_extract.RUN else 0):
                    found.setdefault(tuple(b[k : k + run]), set()).add(i)
        texts = []
        for p in split:
            kept = []
            for b in p:
                run, gone = min(len(b), html_extract.LONG_RUN), set()
                for k in range(len(b) - run + 1):
                    n = len(found.get(tuple(b[k : k + run]), ()))
                    if n >= html_extract.PAGES and n >= html_extract.SHARE * len(pages):
                        gone.update(range(k, k + run))
                kept += [" ".join(w for j, w in enumerate(b) if j not in gone)]
            texts.append("\n".join(x for x in kept if x))
        return texts

    want = brute([html_extract.blocks_of(h)[0] for _, _, h in rows])
    assert [out[i] for i, _, _ in rows] == want


def test_structure_guards_articles_and_repeated_frames_go_wherever_they_stand(spark):
    """Shared articles stay; a frame that the host shows outside articles goes inside one too; comments and scripts name nothing."""
    shared = "this long passage is quoted by every single page of the host and is part of each article"
    notice = "sign up to our weekly letter now"
    page = lambda i: f"<nav><p>Home About Contact Search</p></nav><article><p>Tale {i}</p><p>{shared}</p><p>{notice}</p></article><div>{notice}</div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    rows += [(10 + i, f"http://g.example/{i}", f"<!-- <article> --><script>'<main>'; if(a<b){{\"</p>\"}}</script><div>Menu of the whole shop</div><p>Only text {i} of it</p>") for i in range(3)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 5):
        out = {r.page_id: r.text for r in html_extract.extract_main_text(table.repartition(parts)).collect()}
        assert all(out[i] == f"Tale {i}\n{shared}" for i in range(6))
        assert all(out[10 + i] == f"Only text {i} of it" for i in range(3))


@pytest.mark.parametrize("piece", ["<", "<script>", '<a "', "<!--", "<a '\">", '<div class="', "<nav>", "<p>a<p>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    html_extract.page_blocks(piece * (200_000 // len(piece)))
    assert time.perf_counter() - start < 1.5


# --- Jaccard


def brute_components(rows, width, hundredths):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("width", "hundredths", "block"), [(3, 90, 1024), (5, 80, 8), (2, 60, 8)])
def test_components_equal_brute_force(spark, monkeypatch, width, hundredths, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MANY", min(64, block))
    rng = random.Random(width)
    rows = [(900, None), (901, ""), (902, " \t "), (903, "Ab"), (904, "aB"), (905, "É"), (906, "é")]
    for family in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 30, 90)))]
        for k in range(rng.choice((1, 12, 25))):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((family * 50 + k, " ".join(words)))
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(table, width, hundredths / 100).collect()}
    assert got == brute_components(rows, width, hundredths)


def test_texts_that_share_an_id_keep_their_links(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b = words("a", 60), words("b", 60)
    rows = [(5, a), (5, b), (7, a + " end"), (3, b + " end"), (9, "apart from all of them"), (5, "")]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert out == [(3, 57, 3), (5, 0, 5), (5, 56, 3), (5, 56, 3), (7, 57, 3), (9, 1, 9)]


def test_frequent_shingles_in_parts_equal_brute_force(spark, monkeypatch):
    """Hubs of several parts of one shingle, and partners of one class over several tasks."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 2)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    monkeypatch.setattr(jaccard_join, "heat_of", lambda sketch: np.maximum(sketch - 1, 0).astype(np.float32))
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: 30 + i % 9], f"x{i}"])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.9).collect()}
    assert got == brute_components(rows, 3, 90)


def test_repeated_rows_and_nothing(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "A B C D E F")], "doc_id bigint, text string")
    out = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.similar_documents(table).collect())
    assert out == [("1", "1"), ("1", "1"), ("5", "1"), ("None", "None")]
    assert jaccard_join.similar_documents(table.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=40))
def test_sketches_never_differ_more_than_sets(a, b):
    one, two = (np.frombuffer(jaccard_join.odd_sketch(np.array(sorted(x), np.uint64)), np.uint8) for x in (a, b))
    assert np.bitwise_count(one ^ two).sum() <= len(a ^ b)


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\>im_startend\n a", max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format._unrole(chat_format._role(text)) == text


def test_examples_and_their_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", said), (1, 3, "assistant", None), (1, 4, "user", "bye"), (2, 0, "user", "alone"), (None, 0, "assistant", "x"), (3, None, None, None), (3, 5, "assistant", "é")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, target string")
    examples = chat_format.expand_targets(table)
    rows = [r for r in examples.collect() if r.conv_id == 1]
    assert [(r.target, chat_format.unescape(r.formatted[r.loss_start : r.loss_end])) for r in rows] == [(2, said), (3, ""), (None, "")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (out[conv].n_turns, out[conv].turns_sha256) == (len(own), digest("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), digest(loss))
    assert chat_format.expand_targets(table.limit(0)).count() == 0
