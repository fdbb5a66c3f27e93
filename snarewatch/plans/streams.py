"""Streaming queries, run to the end of what is there, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.plans.links import EXPLODED_SQL, score_sql
from snarewatch.plans.usage import SQL as USAGE_SQL
from snarewatch.plans.usage import _CHECKS
from snarewatch.sources.fixtures import Tables, shared_folder
from snarewatch.streaming import streams as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: By how much the closing row of ``drain`` is later than the last of a stream.
LONG_AFTER = "interval 3650 days"


def drain(t: Tables, rows: DataFrame, build, mode: str = "append", closing: str = "", files: int = 0) -> DataFrame:
    """Write ``rows`` as files, stream them through ``build`` to their end, and read what came out.

    With ``closing``, the name of an id, a row that has a time far ahead and nulls else follows
    when all others are through, so that what waits for the watermark comes out. ``files``
    deals the rows to so many files by chance and takes one a batch. State lies in a part a core:
    every part starts a store and a Python worker in every batch, whatever it holds.
    """
    folder = shared_folder(t.spark)
    (rows.repartition(files) if files else rows).write.parquet(f"{folder}/in")
    reader = t.spark.readStream.schema(rows.schema)
    source = (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(f"{folder}/in")
    settings = {"spark.sql.streaming.stateStore.providerClass": S.STATE_STORE, "spark.sql.shuffle.partitions": str(t.spark.sparkContext.defaultParallelism)}
    was = {name: t.spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        t.spark.conf.set(name, value)

    def through() -> None:
        done = build(source).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            done.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        else:
            done.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()

    try:
        through()
        if closing:
            end = rows.agg(F.max("ts").alias("ts")).withColumn("ts", (F.col("ts") + F.expr(LONG_AFTER)).cast(rows.schema["ts"].dataType))
            names = [F.col(c) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
            end.select(names).write.mode("append").parquet(f"{folder}/in")
            through()
    finally:
        for name, value in was.items():
            t.spark.conf.set(name, value)
    return t.spark.read.parquet(f"{folder}/out")


_NUMBERED = f"(select message_id * 100 + position as mp, url from ({EXPLODED_SQL}))"


@query(f"select mp // 100 as message_id, cast(mp % 100 as integer) as position, score, level from ({score_sql(_NUMBERED, 'url', 'mp')})")
def stream_link_scoring(t: Tables) -> DataFrame:
    return drain(t, t["message_text"], S.link_scores).select("message_id", "position", "score", "level")


@query("""select user_id, cast(ts as date) as day, count(*) filter (kind = 'file') as files_used, count(*) filter (kind = 'link') as links_used, cast(sum(tokens) as bigint) as tokens_used from usage_requests group by 1, 2""")
def stream_daily_usage(t: Tables) -> DataFrame:
    out = drain(t, t["usage_requests"].withColumn("ts", F.col("ts").cast("timestamp")), S.daily_usage, "update")
    return out.groupBy("user_id", "day").agg(*[F.max(c).alias(c) for c in ("files_used", "links_used", "tokens_used")])


@query(USAGE_SQL["greedy_gap"])
def stream_greedy_gap(t: Tables) -> DataFrame:
    return drain(t, t.sql(_CHECKS), lambda d: S.gaps(d, "link_id", 86400), closing="id")


@query(USAGE_SQL["failure_alerts"].replace("select service, id from g where kept", "select service, id as event_id from g where kept"))
def stream_failure_alerts(t: Tables) -> DataFrame:
    return drain(t, t["backend_failures"], S.failure_alerts, closing="event_id")


@query(f"select link_id, count(*) as n from ({USAGE_SQL['verdict_cache']}) group by 1")
def stream_seen_dedup(t: Tables) -> DataFrame:
    """How many checks of each link the one-hour rule keeps, by the exact form."""
    kept = drain(t, t.sql(_CHECKS), lambda d: S.gaps(d, "link_id", 3600), closing="id")
    return kept.groupBy("link_id").agg(F.count("*").alias("n"))


@query("""with m as (select m.message_id, user_id % 7 as owner_id, message_id % 5 as sender_id, link_text <> '' as has_link, verdict from messages m join model_verdicts v on v.message_id = m.message_id)
  select message_id, owner_id, verdict from m where sender_id <> owner_id and owner_id <> 3 and (has_link or verdict <> 'Not a Scam')""".replace("message_id % 5", "m.message_id % 5"))
def stream_owner_alerts(t: Tables) -> DataFrame:
    rows = t["messages"].select("message_id", (F.col("user_id") % 7).alias("owner_id"), (F.col("message_id") % 5).alias("sender_id"), (F.col("link_text") != "").alias("has_link"))
    trials = t["messages"].select((F.col("user_id") % 7).alias("owner_id")).distinct().withColumn("blocked", F.col("owner_id") == 3)
    verdicts = t["model_verdicts"].select("message_id", "verdict")
    return drain(t, rows, lambda d: S.owner_alerts(d, verdicts, trials))
