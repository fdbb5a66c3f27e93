"""Ordered folds over keys of any size: time segments are summed up, the sums are folded, segments are finished.

A fold that looks at all rows of a key in order would run in one task for each key. Here a key
is cut into segments of time. Each is reduced to what any fold that enters it must know, a few
numbers; those are folded in order, one row or a few a segment; and each segment is then
finished on its own from the state in which the fold enters it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Gaps that a segment is long, and seconds of one where there is no gap.
GAPS, SEGMENT = 4, 3600


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows equal in their first ``width`` columns, each whole; one run is held at a time."""
    now, held = None, []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and names[end] == names[at]:
                end += 1
            if names[at] != now:
                if held:
                    yield now, held
                now, held = names[at], []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield now, held


def _numbers(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([p.column(column).to_numpy() for p in parts])


def kept_by_gap(rows: DataFrame, key: str, seconds: int, strict: bool, gaps: int = GAPS) -> DataFrame:
    """Rows of each key that come more than ``seconds`` after the last one kept: key, id.

    Not a session: a row that is dropped does not prolong the gap. With ``strict`` unset, a
    row exactly at the gap is kept. Reads the key, id and ts; of equal times the smaller id
    goes first. ``seconds`` > 0; rows without a key or a time are left out.

    A segment is ``gaps`` gaps long, so it keeps few rows, whichever of its first gap's rows
    the fold comes to first. Its sum says for each of those where the fold leaves it; as folds
    soon meet, most say the same and become one row.
    """
    gap = seconds * 1_000_000
    kind = rows.schema[key].dataType
    name, number = kind.simpleString(), to_arrow_type(kind)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = rows.select(key, F.col("id").cast("bigint").alias("id"), at.alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    cut = cut.select(key, F.floor(F.col("at") / (gap * gaps)).alias("segment"), "at", "id")
    sides = "right" if strict else "left"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (k, segment), parts in _groups(batches, 2):
            times = np.unique(_numbers(parts, 2))
            after = np.searchsorted(times, times + gap, sides)
            # whatever was kept before the segment, the fold enters it in its first gap or at the first row behind that
            entry = np.arange(min(len(times), np.searchsorted(times, segment * gap * gaps + gap, "left") + 1))
            end = entry.copy()
            while (after[end] < len(times)).any():
                end = np.where(after[end] < len(times), after[np.minimum(end, len(times) - 1)], end)
            last = np.flatnonzero(np.append(np.diff(end) != 0, True))
            out += [(k, segment, e, x) for e, x in zip(times[entry[last]].tolist(), times[end[last]].tolist())]
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple], names: tuple[str, ...] = (key, "segment", "entry", "end")) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, number if i == 0 else pa.int64()) for i, c in enumerate(zip(*out))], names=list(names))

    summed = cut.select(key, "segment", "at").repartition(F.col(key), F.col("segment")).sortWithinPartitions(key, "segment", "at").mapInArrow(sums, f"{key} {name}, segment bigint, entry bigint, end bigint")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The time kept last before each segment; none before a key's first."""
        now, last, segment, done = None, None, None, True
        out: list[tuple] = []
        for batch in batches:
            for k, s, entry, end in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    now, last, segment = k, None, None
                if s != segment:
                    out.append((k, s, last))
                    segment, done = s, False
                if not done and (last is None or (entry - last > gap if strict else entry - last >= gap)):
                    last, done = end, True
            if out:
                yield batch_of(out, (key, "segment", "last"))
                out = []

    before = summed.repartition(F.col(key)).sortWithinPartitions(key, "segment", "entry").mapInArrow(entered, f"{key} {name}, segment bigint, last bigint")
    states = before.select(key, "segment", F.lit(0).alias("side"), F.col("last").alias("at"), F.lit(None).cast("bigint").alias("id"))
    stream = states.unionByName(cut.select(key, "segment", F.lit(1).alias("side"), "at", "id"))
    stream = stream.repartition(F.col(key), F.col("segment")).sortWithinPartitions(key, "segment", "side", "at", "id")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for k, s, side, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if side == 0:
                    now, last = (k, s), t
                    keep.append(False)
                    continue
                fresh = last is None or (t - last > gap if strict else t - last >= gap)
                if fresh:
                    last = t
                keep.append(fresh)
            few = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(4)], names=[key, "id"])

    return stream.mapInArrow(finished, f"{key} {name}, id bigint")


def within_last(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """Add recent: the rows of the key in the last ``seconds``, the row's own second included.

    ``rows`` has ``at`` in whole seconds. A window spans two segments of its own length, so
    every row counts in its segment and is lent to the next one.
    """
    segment = F.floor(F.col("at") / seconds)
    lent = rows.withColumn("segment", F.explode(F.array(segment, segment + 1))).withColumn("own", F.col("segment") == segment)
    recent = Window.partitionBy(key, "segment").orderBy("at").rangeBetween(-seconds, Window.currentRow)
    return lent.withColumn("recent", F.count("*").over(recent)).where("own").drop("segment", "own")


def run_lengths(rows: DataFrame, key: str, seconds: int = SEGMENT) -> DataFrame:
    """Add nth: of how many rows with ``failed`` in a row of the key this one is the last, 0 where it did not fail.

    ``rows`` has the key, ts, event_id and failed; order is by ts, then event_id. A segment's
    sum is its number of rows, whether all failed, and its run at the end; the run that enters
    a segment is the sum over the all-failed ones before it and the run at the end of the last
    other one.
    """
    cut = rows.withColumn("failed", F.coalesce("failed", F.lit(False))).withColumn("segment", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)))
    order = Window.partitionBy(key, "segment").orderBy("ts", "event_id")
    island = cut.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    inside = island.withColumn("nth", F.count_if("failed").over(Window.partitionBy(key, "segment", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = F.max_by(F.when(F.col("failed"), F.col("nth")).otherwise(0), F.struct("ts", "event_id"))
    sums = inside.groupBy(key, "segment").agg(F.bool_and("failed").alias("all"), ends.alias("tail"))
    along = Window.partitionBy(key).orderBy("segment")
    stretch = sums.withColumn("stretch", F.sum(F.when(F.col("all"), 0).otherwise(1)).over(along))
    through = Window.partitionBy(key, "stretch").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = stretch.withColumn("ended", F.sum("tail").over(through))
    entering = ended.select(key, "segment", F.coalesce(F.lag("ended").over(along), F.lit(0)).alias("enters"))
    told = inside.join(entering.hint("merge"), [key, "segment"])
    # the run that enters goes on until the segment's first row that did not fail
    nth = F.when(F.col("failed"), F.col("nth") + F.when(F.col("island") == 0, F.col("enters")).otherwise(0)).otherwise(0)
    return told.withColumn("nth", nth.cast("int")).drop("segment", "island", "enters")
