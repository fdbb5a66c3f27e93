"""Streaming forms: stateless scoring, tumbling usage counters, gaps and alerts.

Times are event times. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from snarewatch.operators import links as L


def link_scores(messages: DataFrame) -> DataFrame:
    """Score the links of arriving messages; stateless, so any trigger and sink will do."""
    return L.lexical_score(L.explode_links(messages), "url").select("message_id", "position", "url", "score", "level")


def daily_usage(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Running counters per user and UTC day, for update or append mode."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    used = timed.groupBy(F.window("ts", "1 day"), "user_id").agg(
        F.count_if(F.col("kind") == "file").alias("files_used"), F.count_if(F.col("kind") == "link").alias("links_used"), F.sum("tokens").alias("tokens_used")
    )
    return used.select(F.to_date("window.start").alias("day"), "user_id", "files_used", "links_used", "tokens_used")


def seen_dedup(checks: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drop repeats of a link that arrive within the delay, at least; ``gaps`` is exact."""
    return checks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(["link_id"])


#: Rows wait in slices of so many microseconds until the watermark has passed theirs.
WAIT = 60_000_000
#: The state store that list states and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time, whatever order they arrive in.

    Rows wait in a list state. A timer at the end of the slice of time that holds the earliest
    one fires when the watermark has passed it, and all rows of slices before the watermark are
    folded in order, as nothing earlier can arrive then. So waiting rows are read once a batch,
    however many slices they fill. A subclass gives the fold: its state as a schema, and
    ``step``. Rows of one slice, so of one time stamp or second, are always folded together.
    """

    state = "last bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint")
        self.folded = handle.getValueState("folded", self.state)

    def step(self, rows: list[tuple[int, int]], state: tuple | None) -> tuple[list[int], tuple]:
        """Ids that the fold keeps of ``rows`` (at, id) in order, and the state after them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            frame = frame[frame["id"].notna()]
            if len(frame):
                pairs = list(zip(frame["at"].astype("int64").tolist(), frame["id"].astype("int64").tolist()))
                self.waiting.appendList(pairs)
                first = min(pairs)[0]
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self.wake(earliest)
        return iter(())

    def wake(self, at: int) -> None:
        """Have a timer fire when the slice of ``at`` has ended."""
        self.handle.registerTimer((at // WAIT + 1) * WAIT // 1000)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 // WAIT * WAIT
        rows = sorted((r[0], r[1]) for r in self.waiting.get())
        due = rows[: bisect_left(rows, (until,))]
        kept: list[int] = []
        if due:
            kept, state = self.step(due, tuple(self.folded.get()) if self.folded.exists() else None)
            self.folded.update(state)
            if len(due) < len(rows):
                self.waiting.put(rows[len(due) :])
                self.wake(rows[len(due)][0])
            else:
                self.waiting.clear()
        if kept:
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(kept), dtype=object), "id": kept})

    def close(self) -> None:
        pass


class Gap(InOrder):
    """Keep a row if it comes after the last one kept by the gap; the state is one time stamp."""

    def __init__(self, gap: int, strict: bool) -> None:
        self.gap, self.strict = gap, strict

    def step(self, rows: list[tuple[int, int]], state: tuple | None) -> tuple[list[int], tuple]:
        last, kept = state[0] if state else None, []
        for at, i in rows:
            if last is None or (at - last > self.gap if self.strict else at - last >= self.gap):
                last = at
                kept.append(i)
        return kept, (last,)


class Alert(InOrder):
    """Keep a failure if enough came within the window and no alert did; all failures of a second count for each of them.

    The state is the seconds of the last ``least`` failures and the time of the last alert.
    """

    state = "recent array<bigint>, last bigint"

    def __init__(self, least: int, seconds: int) -> None:
        self.least, self.seconds = least, seconds

    def step(self, rows: list[tuple[int, int]], state: tuple | None) -> tuple[list[int], tuple]:
        recent, last = (list(state[0] or []), state[1]) if state else ([], None)
        counts, kept = Counter(at // 1_000_000 for at, _ in rows), []
        for at, i in rows:
            second = at // 1_000_000
            recent = (recent + [second] * min(counts.pop(second, 0), self.least))[-self.least :]
            if len(recent) >= self.least and recent[0] >= second - self.seconds and (last is None or at - last >= self.seconds * 1_000_000):
                last = at
                kept.append(i)
        return kept, (recent, last)


def _in_order(rows: DataFrame, key: str, processor: InOrder, late: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    ts = F.col("ts").cast("timestamp")
    timed = rows.select(F.col(key).alias("key"), F.col("id").cast("bigint").alias("id"), F.unix_micros(ts).alias("at"), ts.alias("ts")).withWatermark("ts", late)
    out = timed.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, id bigint", "Append", "EventTime")
    return out.select(F.col("key").alias(key), "id")


def gaps(rows: DataFrame, key: str, seconds: int, strict: bool = True, late: str = "1 hour") -> DataFrame:
    """Rows (key, id) kept if they come after the last kept one of their key by the gap.

    Exact for rows that arrive no later than ``late`` after the newest, in any order; later
    ones are dropped. A row comes out when the watermark has passed it. Rows without an id
    only move the watermark. ``seconds`` > 0.
    """
    return _in_order(rows, key, Gap(seconds * 1_000_000, strict), late)


def failure_alerts(failures: DataFrame, least: int = 3, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """Alerts per service: ``least`` failures in the window, none sent within it; service, event_id."""
    rows = failures.select("service", F.col("event_id").alias("id"), "ts")
    return _in_order(rows, "service", Alert(least, seconds), late).withColumnRenamed("id", "event_id")


def owner_alerts(messages: DataFrame, verdicts: DataFrame, trials: DataFrame) -> DataFrame:
    """What an owner is told of arriving messages: not their own, not after the trial.

    ``messages`` has message_id, owner_id, sender_id, has_link; ``verdicts``
    (message_id, verdict) and ``trials`` (owner_id, blocked) are static. Silent for a
    text-only message that is no scam.
    """
    live = messages.where("sender_id <> owner_id").join(trials, "owner_id", "left").where(~F.coalesce("blocked", F.lit(False)))
    told = live.join(verdicts, "message_id")
    return told.where("has_link or verdict <> 'Not a Scam'").select("message_id", "owner_id", "verdict")
