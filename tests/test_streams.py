"""Stateful streams against a fold in plain Python, over many ordered batches."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from snarewatch.plans import streams
from snarewatch.plans.usage import _CHECKS
from snarewatch.sources.fixtures import Tables
from snarewatch.streaming import streams as S

SMALL = "/root/testdata/sf0.001"


def kept(rows, seconds):
    last, out = {}, []
    for key, row_id, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or at - last[key] > seconds * 1_000_000:
            last[key] = at
            out.append((key, row_id))
    return out


@pytest.fixture
def tables(spark):
    return Tables(spark, SMALL)


def test_checks_after_the_hour_are_kept(tables):
    checks = [tuple(r) for r in tables.sql(_CHECKS).select("link_id", "id", F.unix_micros(F.col("ts").cast("timestamp"))).collect()]
    want = Counter(key for key, _ in kept(checks, 3600))
    assert max(want.values()) > 1
    assert {r.link_id: r.n for r in streams.stream_seen_dedup(tables).collect()} == want


def test_rows_in_any_order_within_the_watermark_give_the_exact_result(tables):
    # five batches of rows dealt by chance, all within two hours; ties and repeats as well
    rows = tables.spark.range(600).select((F.col("id") % 3).cast("string").alias("k"), "id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 6000).alias("ts"))
    out = streams.drain(tables, rows, lambda d: S.gaps(d, "k", 60, late="2 hours"), closing="id", files=5)
    want = kept([(r.k, r.id, r.ts.timestamp() * 1e6) for r in rows.collect()], 60)
    assert sorted((r.k, r.id) for r in out.collect()) == sorted(want)


def test_failures_of_one_second_count_together(tables):
    at = [(1, 1000), (2, 1000), (3, 1000), (4, 2000), (5, 4600), (6, 4600), (7, 4600), (8, 9000), (9, 12601), (10, 12602)]
    rows = tables.spark.createDataFrame([("a", i, s) for i, s in at], "service string, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = streams.drain(tables, rows, lambda d: S.failure_alerts(d, late="5 hours"), closing="event_id", files=3)
    seconds, last, want = defaultdict(int), None, []
    for _, s in at:
        seconds[s] += 1
    for i, s in at:
        if sum(n for x, n in seconds.items() if s - 3600 <= x <= s) >= 3 and (last is None or s - last >= 3600):
            want.append(i)
            last = s
    assert want == [1, 5] and sorted(r.event_id for r in out.collect()) == want


def test_folds_of_slices_equal_one_fold():
    gap, rows = S.Gap(10, strict=False), [(i * 3, i) for i in range(50)]
    whole, _ = gap.step(rows, None)
    first, state = gap.step(rows[:20], None)
    assert whole == first + gap.step(rows[20:], state)[0]


class Handle:
    """States and timers of one key in memory; counts how often the waiting rows are read."""

    def __init__(self):
        self.rows, self.timers, self.reads = [], set(), 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.add(at)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def clear(self):
        self.rows = []


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_waiting_rows_are_read_once_a_batch_whatever_their_number():
    # 1000 rows in 1000 slices: a timer a slice read all that waited 1000 times
    import pandas as pd

    handle, gap = Handle(), S.Gap(90_000_000, strict=True)
    handle.getValueState = lambda name, schema: Value()
    gap.init(handle)
    rows = [(i * 60_000_000, i) for i in range(1000)]
    list(gap.handleInputRows(("k",), iter([pd.DataFrame(rows[::-1], columns=["at", "id"])]), Times(0)))
    assert len(handle.timers) == 1
    out = [i for f in gap.handleExpiredTimer(("k",), Times(600 * 60_000), Times(min(handle.timers))) for i in f["id"]]
    assert handle.reads == 1 and sorted(r[1] for r in handle.rows) == list(range(600, 1000)) and len(handle.timers) == 2
    out += [i for f in gap.handleExpiredTimer(("k",), Times(2000 * 60_000), Times(max(handle.timers))) for i in f["id"]]
    assert handle.reads == 2 and not handle.rows and len(handle.timers) == 2
    assert out == gap.step(rows, None)[0] == list(range(0, 1000, 2))
