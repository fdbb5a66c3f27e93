"""Digests of windows against hashlib, and signatures against a plain model."""

import hashlib
import random
import time

from snarewatch.functions.digests import CHUNK, window_heads
from snarewatch.operators import vectors as V


def head(text):
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")


def texts(seed):
    rng = random.Random(seed)
    letters = ["abc d", "aé", "aបក", "a😀é"]
    made = ["".join(rng.choice(rng.choice(letters)) for _ in range(n)) for n in (0, 1, 7, 8, 9, 15, 64, 500, CHUNK + 9)]
    return made + ["x" * 40, "😀" * 30, "", "ាា" * 9]


def test_heads_of_windows_equal_those_of_hashlib():
    for seed in range(3):
        some = texts(seed)
        for width in (8, 5):
            found = [h.tolist() for h in window_heads(some, width)]
            assert found == [[head(t[i : i + width]) for i in range(max(1, len(t) - width + 1))] for t in some]


def test_signatures_equal_minima_over_distinct_shingles(spark):
    some = [" ".join(t.split()) for t in texts(5)]
    rows = spark.createDataFrame(list(enumerate(some)), "id bigint, text string")
    got = {r.id: list(r.signature) for r in V.minhash(rows, "id", "text").collect()}
    for i, t in enumerate(some):
        x = [head(s) % V.PRIME for s in {t[j : j + 8] for j in range(max(1, len(t) - 7))}]
        assert got[i] == [min((v * a + b) % V.PRIME for v in x) for a, b in map(V.affine, range(V.HASHES))]


def test_many_windows_cost_less_than_a_digest_each():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300_000))
    began = time.process_time()
    plain = [hashlib.md5(text[i : i + 8].encode()).digest() for i in range(len(text) - 7)]
    middle = time.process_time()
    found = window_heads([text])[0]
    assert len(plain) == len(found) and time.process_time() - middle < middle - began
