"""The memory of checked links against a plain loop over checks in order."""

import random

import numpy as np
import pyarrow as pa
import pytest

from snarewatch.operators import memory as M
from snarewatch.operators import vectors as V
from snarewatch.operators.vectors import nearest

SHAPE = "scan_id bigint, at bigint, key string, text string, kept string, level string, trusted boolean"


def unit(text):
    return V.unit_rows([text], {})[0]


def looped(spark, rows, k=4, least=0.75):
    """Points of each check: the memory is a dict that every check reads and then writes to."""
    asked = spark.createDataFrame([(t,) for t in {r[3] or "" for r in rows}], "text string")
    seeds = {}
    for r in nearest(asked, "text", "text", ("brand", "phish"), k).collect():
        seeds.setdefault(r.text, []).append((-r.similarity, r.kind, r.seed_key, None))
    vectors = {t: unit(t) for r in rows for t in (r[3] or "", r[4] or "")}
    held, out = {}, {}
    for scan, at, key, text, kept, level, trusted in sorted((r for r in rows if None not in (r[0], r[1], r[2])), key=lambda r: (r[1], r[0])):
        near = [(-(round(float(vectors[text or ""] @ vectors[old]), V.DIGITS) + 0.0), "seen", k2, lab) for k2, (old, lab) in held.items()]
        top = sorted(seeds.get(text or "", []) + [x for x in near if x[0] <= -least], key=lambda x: x[:3])[:k]
        seen = 0 if trusted else sum(x[1] == "seen" and x[0] <= -least and x[3] in ("suspicious", "dangerous") for x in top)
        out[scan] = (seen, M.SEEN_POINTS if seen else 0)
        held[key] = (kept or "", level)
    return out


@pytest.mark.parametrize("seconds,block,centres", [(86_400, 2048, 4096), (50, 3, 2)])
def test_memory_equals_a_loop_over_checks(spark, monkeypatch, seconds, block, centres):
    monkeypatch.setattr(M.blocks, "__defaults__", (seconds, block))
    monkeypatch.setattr(M, "CENTRES", centres)
    rng = random.Random(3)
    hosts = ["https://ababamk.com/secure", "http://paypal-account-update.info/confirm", "https://blog.example.org/en", "https://www.faceb00k.com/p", "http://x7k2qz9w4v.com"]
    rows = []
    for i in range(160):
        h = rng.randrange(5)
        text = f"{hosts[h]}/{rng.randrange(6)}"
        said = text + rng.choice(["", "", " page of words"])
        # equal times, keys that change their text and label, one key of a third of all checks
        rows.append((i, rng.randrange(120) * 1_000_000, "hot" if i % 3 == 0 else text[-30:], text, said, rng.choice(["safe", "suspicious", "dangerous"]), h == 2))
    rows += [(900, 5_000_000, None, "x", "x", "dangerous", False), (901, None, "k", "x", "x", "dangerous", False), (902, 7_000_000, "n", None, None, "dangerous", False), (903, 8_000_000, "n", hosts[0], None, None, False)]
    rng.shuffle(rows)
    scans = spark.createDataFrame(rows, SHAPE)
    got = {r.scan_id: (r.seen, r.points) for r in M.seen_memory(scans, seconds=seconds).collect()}
    want = looped(spark, rows)
    assert got == want and {p for _, p in want.values()} == {0, 20} and any(n > 1 for n, _ in want.values())


def test_an_empty_memory_says_nothing(spark):
    assert M.seen_memory(spark.createDataFrame([], SHAPE)).count() == 0
    one = spark.createDataFrame([(1, 5, "k", "http://a.com", "http://a.com", "dangerous", False)], SHAPE)
    assert [tuple(r) for r in M.seen_memory(one).collect()] == [(1, 0, 0)]


def test_unit_rows_keep_the_order_of_texts():
    rows = V.unit_rows(["pay now", None, "pay now", "other words"], {})
    assert (rows[0] == rows[2]).all() and not rows[1].any() and np.isclose((rows[3] ** 2).sum(), 1)


def test_equal_texts_meet_a_block_once_and_those_unlike_it_never(monkeypatch):
    hashed, plain = [], M.unit_rows
    monkeypatch.setattr(M, "unit_rows", lambda texts, memo: hashed.append(list(texts)) or plain(texts, memo))
    matrix = plain(["verify account", "free gift card"], {})
    texts = pa.array(["verify account", "garden tools", "free gift card", ""] * 1000)
    found = list(M.alike(texts, matrix, {}, 0.75))
    assert hashed == [["verify account", "garden tools", "free gift card", ""]]
    assert sorted(np.concatenate([rows for rows, _ in found]).tolist()) == [i for i in range(4000) if i % 2 == 0]
    assert all(near[j].argmax() == (i % 4) // 2 and near[j].max() == 1 for rows, near in found for j, i in enumerate(rows))
    many = pa.array([f"word{i} verify account" for i in range(1300)])
    assert sorted(np.concatenate([rows for rows, _ in M.alike(many, matrix, {}, -1.0)]).tolist()) == list(range(1300))
