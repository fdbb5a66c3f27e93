"""Hashed weights of texts against a plain model, and what a task of Python holds and hands on."""

import hashlib
import random
import tracemalloc

import numpy as np

from snarewatch.functions import addresses as A
from snarewatch.operators import vectors as V


def plain(words):
    total = np.zeros(V.BUCKETS)
    for t in words:
        padded = f"^{t}$"
        for feature, w in [("w:" + t, 1.0)] + [("c:" + padded[i : i + 4], 0.5) for i in range(len(t) - 1)] if len(t) > 1 else []:
            h = hashlib.md5(feature.encode()).hexdigest()
            total[int(h[:2], 16)] += -w if int(h[9], 16) % 2 else w
    return total


def test_weights_equal_a_plain_model_also_when_the_memory_is_full(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdkmnq257" if i % 3 else "កខគឃ") for _ in range(rng.choice((1, 2, 3, 9, 41, 300)))) for i in range(300)]
    for most in (V.MEMO, 7):
        monkeypatch.setattr(V, "MEMO", most)
        memo = {}
        for low in range(0, len(words), 10):
            some = words[low : low + 10]
            leet = [w.translate(V._LEET) for w in some]
            assert np.array_equal(V._weights(" ".join(some), memo), plain(leet)) and len(memo) <= most
    assert not V._weights("a . ?", {}).any() and not V.unit_rows(["", None], {}).any()


def test_what_a_task_remembers_of_words_stays_small():
    memo = {}
    tracemalloc.start()
    try:
        for i in range(60_000):
            V._weights(f"paypal{i}update {i * 7919} acc{i}", memo)
        V._weights("x" * 1_000_000, memo)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 12e6 and max(map(len, memo)) <= V.LONGEST


def test_words_without_a_label_behind_a_dot_are_not_searched_for_hosts(monkeypatch):
    asked, search = [], A.hosts
    monkeypatch.setattr(A, "hosts", lambda run: asked.append(run) or search(run))
    assert A.addresses("The end. i. 3.) so...on. foo.com.") == ["foo.com"]
    assert asked == ["so...on.", "foo.com."]
