"""Metering, trials, alerts and logs over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.operators import folds
from snarewatch.sources.fixtures import kept

FILE_LIMIT, LINK_LIMIT, TOKEN_LIMIT, TRIAL_DAYS = 3, 8, 20_000, 7


def usage_summary(requests: DataFrame) -> DataFrame:
    """Files, links and tokens used per user and UTC day, with the limits."""
    used = requests.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("kind") == "file").alias("files_used"), F.count_if(F.col("kind") == "link").alias("links_used"), F.sum("tokens").alias("tokens_used")
    )
    return used.select("*", F.lit(FILE_LIMIT).alias("files_limit"), F.lit(LINK_LIMIT).alias("links_limit"))


def quota_admission(requests: DataFrame) -> DataFrame:
    """Add admitted: the first requests of each kind per user and day, trusted shapes beside them."""
    turn = Window.partitionBy("user_id", F.to_date("ts"), "kind", "trusted_shape").orderBy("ts", "request_id")
    limit = F.when(F.col("kind") == "file", FILE_LIMIT).otherwise(LINK_LIMIT)
    return requests.withColumn("admitted", F.col("trusted_shape") | (F.row_number().over(turn) <= limit))


def folded_quota(events: DataFrame) -> DataFrame:
    """Admission with refunds and late charges: the requests of ``events`` that are admitted.

    ``events`` has event_id, user_id, ts, kind and step: ``use`` takes a slot if one is
    left, ``bypass`` is admitted without one, ``charge`` takes a slot without a check
    (a bypass that proved untrusted), ``refund`` gives one back. Slots are counted per
    user, UTC day and kind in time order; a task streams through its sorted keys
    holding one number. Returns event_id, admitted (null for charge and refund), used.
    """
    keys = ["user_id", "day", "kind"]
    rows = events.select("event_id", "user_id", F.unix_date(F.to_date("ts")).alias("day"), "kind", "step", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, 0
        for batch in batches:
            admitted, counts = [], []
            for user, day, kind, step in zip(*(batch[c] for c in (*keys, "step"))):
                if (user, day, kind) != current:
                    current, used = (user, day, kind), 0
                free = used < (FILE_LIMIT if kind == "file" else LINK_LIMIT)
                admitted.append({"use": free, "bypass": True}.get(step))
                used += {"use": int(free), "charge": 1, "refund": -1 if used else 0}.get(step, 0)
                counts.append(used)
            yield pd.DataFrame({"event_id": batch["event_id"], "admitted": pd.Series(admitted, dtype="object"), "used": counts})

    return ordered.mapInPandas(run, "event_id bigint, admitted boolean, used int")


def token_budget(requests: DataFrame) -> DataFrame:
    """Add spent (tokens before this call today) and allowed."""
    before = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return requests.withColumn("spent", spent).withColumn("allowed", F.col("spent") < TOKEN_LIMIT)


def notify_once(admitted: DataFrame) -> DataFrame:
    """The first denied request of each user and day."""
    denied = admitted.where(~F.col("admitted"))
    return denied.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("request_id"))


def trial_status(events: DataFrame) -> DataFrame:
    """Per event: whole days left of the user's trial, its time, and whether it is over."""
    first = events.groupBy("user_id").agg(F.min("ts").alias("started"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))
    left = F.greatest(F.lit(TRIAL_DAYS) - F.floor(seconds / 86400), F.lit(0))
    told = events.join(first.hint("merge"), "user_id").select("event_id", "user_id", left.cast("bigint").alias("days_left"), "ts")
    return told.withColumn("blocked", F.col("days_left") == 0)


def trial_notices(events: DataFrame) -> DataFrame:
    """The one event at which a user is told that the trial is over: user_id, event_id."""
    return trial_status(events).where("blocked").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def failure_alerts(failures: DataFrame, least: int = 3, seconds: int = 3600) -> DataFrame:
    """Alerts per service: enough failures within the hour, and none sent within it."""
    timed = failures.select("service", F.col("event_id").alias("id"), "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    hot = folds.within_last(timed, "service", seconds).where(F.col("recent") >= least)
    return folds.kept_by_gap(hot.select("service", "id", "ts"), "service", seconds, strict=False)


def failure_streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """Failures that are at least the third in a row of their service: event_id, service, nth, ts."""
    return folds.run_lengths(events, "service").where(F.col("nth") >= least).select("event_id", "service", "nth", "ts")


def outages(streaks: DataFrame, seconds: int = 30) -> DataFrame:
    """Until when each failure of a streak keeps its service out: event_id, service, until_us."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return streaks.select("event_id", "service", (at + seconds * 1_000_000).alias("until_us"))


def tagged_lines(lines: DataFrame) -> DataFrame:
    """Fields of oversize log lines; other lines are left out, unexpected shapes are marked."""
    tagged = lines.where(F.col("line").contains("[oversize-file]"))
    field = lambda name: F.regexp_extract("line", rf"{name}=(\S+)", 1)
    shape = r"\[oversize-file\] reason=\S+ size=\S+ disguised=(True|False)$"
    return tagged.select(
        "event_id", F.substring_index("line", " ", 1).alias("stamp"), field("reason").alias("reason"), field("size").alias("size"),
        (field("disguised") == "True").alias("disguised"), (~F.col("line").rlike(shape)).alias("odd"),
    )


def oversize_report(tagged: DataFrame) -> DataFrame:
    """Counts by reason and size, with the share of disguised names."""
    return tagged.groupBy("reason", "size").agg(
        F.count("*").alias("n"), F.count_if("disguised").alias("n_disguised"), F.count_if("odd").alias("n_odd"),
        F.min("stamp").alias("first"), F.max("stamp").alias("last"),
        F.round(F.count_if("disguised") / F.count("*"), 6).alias("fire_rate"),
    )


def upsert(snapshot: DataFrame | None, batch: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The snapshot after a batch: by key the row that is last in ``order``, old or new."""
    rows = batch if snapshot is None else snapshot.unionByName(batch)
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("row")).select("row.*")


def merge_into(path: str, batch: DataFrame, key: str, order: tuple[str, ...], batch_id: int, parts: int = 64) -> list[int]:
    """Put a batch into a written snapshot: of each key the row that is last in ``order`` stays. Returns the parts rewritten.

    The snapshot lies in ``parts`` folders by a hash of the key. Only folders that the batch
    touches are read and rewritten, from a copy that is written beside them first, so a lost
    executor costs a task; a batch whose number was put in before changes nothing. A key is
    a column without nulls; the snapshot's other columns are those of its first batch.
    """
    spark = batch.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{batch_id}")
    if fs.exists(done):
        return []
    dealt = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    touched = sorted(r.part for r in dealt.select("part").distinct().collect())  # ``parts`` numbers at most
    rows = dealt
    if any(x.getPath().getName().startswith("part=") for x in (fs.listStatus(folder) if fs.exists(folder) else [])):
        rows = rows.unionByName(spark.read.schema(dealt.schema).parquet(path).where(F.col("part").isin(touched)))
    staged = kept(rows.groupBy("part", key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("row")).select("row.*", "part"))
    staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    fs.mkdirs(done)
    return touched


def append_scan_log(verdicts: DataFrame, path: str) -> None:
    """Append sink of verdicts, by day."""
    verdicts.withColumn("dt", F.to_date("checked_at")).write.mode("append").partitionBy("dt").parquet(path)
