"""Segmented folds against plain ones, on keys of many segments, ties and one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from snarewatch.operators import folds, usage


def timed(spark, rows, extra):
    return spark.createDataFrame(rows, f"k string, id bigint, at bigint{extra}").withColumn("ts", F.timestamp_micros("at"))


def plain_gaps(rows, gap, strict):
    last, out = {}, set()
    for k, i, at in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        if k not in last or (at - last[k] > gap if strict else at - last[k] >= gap):
            last[k] = at
            out.add((k, i))
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("gaps", [1, 4])
def test_gaps_equal_a_plain_fold(spark, strict, gaps):
    rng = random.Random(gaps)
    step = 1_000_000
    rows = [("hot", i, rng.randrange(-5000, 4000) * step) for i in range(3000)]
    rows += [(f"k{rng.randrange(40)}", 10_000 + i, rng.choice([0, 10, 20, 30, 40, 41, 400]) * step + rng.choice([0, 0, 1, -1])) for i in range(600)]
    rows += [("even", 20_000 + i, i * 10 * step) for i in range(200)] + [("same", 30_000 + i, 7 * step) for i in range(9)] + [("far", 40_000, -9 * 10**12), ("far", 40_001, 9 * 10**12), (None, 1, 5), ("none", 2, None)]
    rng.shuffle(rows)
    got = folds.kept_by_gap(timed(spark, rows, "").drop("at").repartition(7), "k", 10, strict, gaps)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_gaps(rows, 10 * step, strict)
    assert folds.kept_by_gap(timed(spark, rows, "").limit(0), "k", 10, strict).count() == 0


@pytest.mark.parametrize("seconds", [7, 100, 100_000])
def test_runs_equal_a_plain_fold(spark, seconds):
    rng = random.Random(seconds)
    rows = [(rng.choice("aab"), i, rng.randrange(2000) * 1_000_000, rng.random() < 0.9 if i % 50 else None) for i in range(900)] + [("c", 1000 + i, i * 1_000_000, True) for i in range(300)]
    lengths, want = {}, {}
    for k, i, _, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        lengths[k] = lengths.get(k, 0) + 1 if failed else 0
        want[i] = lengths[k]
    events = timed(spark, rows, ", failed boolean").withColumnRenamed("id", "event_id")
    assert {r.event_id: r.nth for r in folds.run_lengths(events, "k", seconds).collect()} == want


def test_rows_of_the_last_hour_are_counted_across_segments(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(400)) for i in range(300)]
    got = folds.within_last(spark.createDataFrame(rows, "k string, id bigint, at bigint"), "k", 30).collect()
    want = {i: sum(k2 == k and at - 30 <= other <= at for k2, _, other in rows) for k, i, at in rows}
    assert len(got) == len(rows) and {r.id: r.recent for r in got} == want


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), "id", F.timestamp_seconds(F.col("id") * 37 % 1_000_003).alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = folds.kept_by_gap(rows, "k", 60, strict=True)
        tasks = kept.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    n = sum(r["count"] for r in tasks)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.4 * n


def test_alerts_and_streaks_use_segments(spark):
    rows = [("s", i, i * 1000 * 1_000_000, True) for i in range(50)]
    events = timed(spark, rows, ", failed boolean").select(F.col("k").alias("service"), F.col("id").alias("event_id"), "ts", "failed")
    assert [r.event_id for r in usage.failure_alerts(events).orderBy("id").withColumnRenamed("id", "event_id").collect()] == list(range(2, 50, 4))
    assert usage.failure_streaks(events).count() == 48 and usage.outages(usage.failure_streaks(events)).columns == ["event_id", "service", "until_us"]
