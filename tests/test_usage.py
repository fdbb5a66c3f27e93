"""Snapshots and thresholds against plain Python."""

import os
import random

from pyspark.sql import functions as F

from snarewatch.operators import usage as U
from snarewatch.operators import vectors as V


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    rng, path, state = random.Random(2), str(tmp_path / "snapshot"), {}
    for batch_id in range(4):
        rows = [(f"k{rng.randrange(400 if batch_id == 0 else 5)}", rng.randrange(1000), batch_id) for _ in range(600 if batch_id == 0 else 6)]
        before = files(path)
        touched = U.merge_into(path, spark.createDataFrame(rows, "k string, at int, n int"), "k", ("at", "n"), batch_id, parts=16)
        for k, at, n in rows:
            state[k] = max(state.get(k, (-1, -1)), (at, n))
        after = files(path)
        untouched = {f for f in before if not any(f"part={p}/" in f for p in touched)}
        assert all(after.get(f) == before[f] for f in untouched) and (batch_id == 0 or len(untouched) >= 8)
        assert {r.k: (r.at, r.n) for r in spark.read.parquet(path).collect()} == state
    now = files(path)
    assert U.merge_into(path, spark.createDataFrame([("k0", 9999, 9)], "k string, at int, n int"), "k", ("at", "n"), 2, parts=16) == [] and files(path) == now


def test_a_sweep_says_what_every_threshold_does(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, 0.3, 0.305, 0.5, 1.0, -0.2]), False) for _ in range(50)] + [(rng.choice([0.55, 0.6, 0.9, 1.0]), True) for _ in range(30)] + [(None, True), (0.5, None)]
    got = {round(r.threshold, 2): (r.false_hits, r.misses, r.safe) for r in V.threshold_sweep(spark.createDataFrame(rows, "similarity double, scripted boolean")).collect()}
    good, bad = [s for s, x in rows if x and s is not None], [s for s, x in rows if x is False]
    want = {i / 100: (sum(s >= i / 100 for s in bad), sum(s < i / 100 for s in good), max(bad) < i / 100 <= min(good)) for i in range(101)}
    assert got == want
    clear = V.threshold_sweep(spark.createDataFrame([(0.2, False), (0.7, True)], "similarity double, scripted boolean")).where("safe").agg(F.min("threshold"), F.max("threshold")).first()
    assert tuple(clear) == (0.21, 0.7)


def test_the_trial_ends_by_whole_seconds_in_the_statement_as_well(spark, tmp_path):
    import duckdb

    from snarewatch.plans import registry

    # the second event lies 0.6 s before a whole week in seconds counted down, but in it if they are rounded
    rows = [(1, 1, 1_700_000_000_200_000), (2, 1, 1_700_604_799_800_000), (3, 1, 1_700_604_800_100_000), (4, 2, 1_700_000_000_600_000), (5, 2, 1_700_604_800_400_000), (6, 2, 1_700_604_801_700_000)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, at bigint").select("event_id", "user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = {(r.user_id, r.event_id) for r in registry.queries()["trial_notice"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    said = {tuple(r) for r in db.execute(f"select user_id, event_id from ({registry.oracle_sql()['trial_notice']})").fetchall()}
    assert found == said == {(1, 3), (2, 5)}
