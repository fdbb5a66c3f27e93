"""Stages of the pipeline over rows without an id and with repeated ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from snarewatch.llm import common, mixing


def test_mix_takes_each_row_as_its_plan_says(spark):
    common.ensure_checkpoint_dir(spark)
    ids = [None] * 6 + [1, 1, 1, 2, 3, 4]
    rows = [(d, f"s{i % 2}", f"text number {i if i != 8 else 7} with a few words", 30) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_chars int")
    keyed = corpus_pipeline.told_apart(docs, "_row")
    assert keyed.select("_row").distinct().count() == len(rows)
    plan = mixing.mix_sources(keyed.select(F.col("_row").alias("doc_id"), "source", "text"))
    copies = {r.doc_id: r.n for r in plan.select("doc_id", F.size("shards").alias("n")).collect()}
    want = Counter()
    for r in keyed.collect():
        want[r.doc_id, r.source, r.text, r.n_chars] += copies[r._row]
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert Counter(tuple(r) for r in got.collect()) == +want and sum(want.values()) > 0


@pytest.mark.parametrize("known", [0, 100_000])
def test_rows_are_told_apart_alike_by_broadcast_and_by_join(spark, monkeypatch, known):
    monkeypatch.setattr(corpus_pipeline, "KNOWN", known)
    rows = [(None, "a", 1), (None, "a", 1), (None, None, 2), (1, "a", 3), (1, "a", 4), (1, "b", 5), (2, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = corpus_pipeline.told_apart(docs, "row")
    assert got.columns == [*docs.columns, "row"]
    found = got.collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter(rows) and len({r.row for r in found}) == len(rows)
    turns = Counter((r.doc_id, r.text, r.row.rsplit(":", 1)[1]) for r in found)
    assert turns[None, "a", "2"] == turns[1, "a", "2"] == 1 and turns[2, None, "1"] == turns[2, "", "1"] == 1
    assert corpus_pipeline.told_apart(docs.limit(0), "row").count() == 0


ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 3),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "b", 3),
    (3, "completely different words make up this other text which stands alone here", "en", "a", 3),
    (3, "completely different words make up this other text which stands alone here", "en", "b", 4),
    (3, "a second text under an id that is already taken by another one", "en", "b", 4),
    (4, None, "en", "a", 0), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5),
]
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars int"


def test_deduplicate_keeps_one_row_of_each_group_whatever_the_order(spark):
    common.ensure_checkpoint_dir(spark)
    runs = [sorted(map(tuple, corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, SHAPE), "").collect()), key=str) for rows in (ROWS, ROWS[::-1])]
    assert runs[0] == runs[1]
    got = Counter((r[0], r[1]) for r in runs[0])
    assert got == Counter({(1, ROWS[0][1]): 1, (3, ROWS[2][1]): 1, (3, ROWS[4][1]): 1, (4, None): 1, (5, ""): 1, (None, "no id"): 2})
    assert corpus_pipeline.deduplicate(spark, spark.createDataFrame(ROWS, SHAPE).limit(0), "").count() == 0


def test_masking_changes_texts_alone(spark):
    rows = [(1, "mail me at jo.doe@example.org or call +855 12 345 678 now", "en", "a", 9), (2, None, None, None, 1), (2, "", "en", "a", 1), (None, "plain words", "en", "a", 1)]
    got = corpus_pipeline.mask_personal_data(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    assert [(r.doc_id, r.lang, r.source) for r in got] == [(r[0], r[2], r[3]) for r in rows]
    assert "jo.doe" not in got[0].text and "345" not in got[0].text and [r.text for r in got[1:]] == [None, "", "plain words"]
    assert [r.n_chars for r in got] == [len(got[0].text), None, 0, len("plain words")]


def test_encoding_counts_and_digests_every_row(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "hello hello world", "en", "a", 9), (1, "hello hello world", "en", "a", 9), (2, None, "en", "a", 1), (3, "", "en", "a", 1), (None, "x" * 5000 + " ខ្មែរ", "en", "a", 1)]
    real = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    real.no_padding(), real.no_truncation()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = real.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want


def test_quality_keeps_the_rows_that_the_operator_keeps(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.limit(1).selectExpr("-1L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("-2L as doc_id", "'' as text", "lang", "source", "n_chars"))
    got = corpus_pipeline.quality(spark, docs.unionByName(more.select(*docs.columns)).unionByName(docs.where("doc_id < 20")), folder)
    assert got.columns == docs.columns and got.where("doc_id < 0").count() == 0
    counts = {r["count"] for r in got.where("doc_id between 0 and 19").groupBy("doc_id").count().collect()}
    assert counts == {2}
