"""The memory of checked links: which earlier links a checked one resembles, and what was said of them.

Every check leaves an entry under its key, which the next check of that key replaces. A check
sees the entries as they stood just before it. Entries lie in blocks of one time slice and
similar texts; a block is a matrix, and checks meet it only if they come later than its first
entry and could resemble one of its entries by the bound on the cosine that the block's centre
and radius give. Nothing is a pair but a check and at most ``k`` entries of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.operators.vectors import BUCKETS, DIGITS, nearest, unit_rows
from snarewatch.sources.fixtures import kept

SEEN_POINTS, SEEN_LEAST, NEIGHBOURS = 20, 0.75, 4
#: Seconds of a time slice, and entries of a block.
SLICE, BLOCK = 86_400, 2048
#: Checks that meet a block at a time.
CHECKS = 4096
#: Centres of blocks that go to every task at a time, some 8 MB.
CENTRES = 4096


def last_before(marks: DataFrame, events: DataFrame, key: str, value: str, seconds: int = SLICE) -> DataFrame:
    """``marks`` with ``value`` of the last event of their key that lies before them, null if none.

    Both have the key, ``at`` (microseconds) and ``scan_id``, by which they are ordered; an
    event at a mark's own place is not before it. A key is cut into time slices: the last
    event within a slice is carried in order, the last of earlier slices comes from one row a
    slice, so that a key of very many rows falls to many tasks.
    """
    sliced = lambda df: df.withColumn("slice", F.floor(F.col("at") / (seconds * 1_000_000)))
    own = [c for c in marks.columns]
    one = sliced(marks).select(*own, "slice", F.lit(0).alias("side"), F.lit(None).cast(events.schema[value].dataType).alias("said"))
    rows = sliced(events.select(key, "at", "scan_id", F.col(value).alias("said")))
    two = rows.select(*[F.col(c) if c in (key, "at", "scan_id") else F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in own], "slice", F.lit(1).alias("side"), "said")
    within = Window.partitionBy(key, "slice").orderBy("at", "scan_id", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = one.unionByName(two).withColumn("near", F.last(F.when(F.col("side") == 1, F.struct("said")), ignorenulls=True).over(within)).where("side = 0")
    by_slice = rows.groupBy(key, "slice").agg(F.max_by(F.struct("said"), F.struct("at", "scan_id")).alias("end"))
    asked = one.select(key, "slice").distinct().withColumn("end", F.lit(None).cast(by_slice.schema["end"].dataType))
    earlier = Window.partitionBy(key).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    before = by_slice.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    before = before.withColumn("far", F.last("end", ignorenulls=True).over(earlier)).where("asked").select(key, "slice", "far")
    told = carried.join(before.hint("merge"), [key, "slice"])
    return told.select(*own, F.coalesce(F.col("near")["said"], F.col("far")["said"]).alias(value))


def entries(scans: DataFrame, seconds: int = SLICE) -> DataFrame:
    """What the memory holds and when: key, kept (its text), start_at, start_id, end_at, end_id.

    An entry counts after its start up to and with its end, null if it is never replaced. A
    check that keeps the same text only changes the label, so its entry goes on. Changes are
    found within time slices first; of each slice one row at least goes on to its key.
    """
    rows = scans.select("key", "kept", "at", "scan_id").withColumn("slice", F.floor(F.col("at") / (seconds * 1_000_000)))
    order = ["at", "scan_id"]

    def changed(df: DataFrame, *by: str) -> DataFrame:
        was = F.lag("kept").over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn("was", was).where(F.col("was").isNull() | (F.col("was") != F.col("kept"))).drop("was")

    # a slice's last text is that of its last change, so nothing is lost between slices
    firsts = changed(changed(rows, "key", "slice"), "key")
    turn = Window.partitionBy("key").orderBy(*order)
    return firsts.select("key", "kept", F.col("at").alias("start_at"), F.col("scan_id").alias("start_id"), F.lead("at").over(turn).alias("end_at"), F.lead("scan_id").over(turn).alias("end_id"))


def blocks(held: DataFrame, seconds: int = SLICE, most: int = BLOCK) -> DataFrame:
    """Add block to entries: by time slice of the start and nearest reference text, cut to ``most`` rows by key."""
    near = nearest(held.select("key", "kept").distinct(), "key", "kept", ("brand", "phish"), 1).groupBy("key").agg(F.min("seed_key").alias("seed"))
    rows = held.join(near.hint("merge"), "key", "left").withColumn("slice", F.floor(F.col("start_at") / (seconds * 1_000_000)))
    group = F.xxhash64("slice", "seed")
    rows = kept(rows.withColumn("group", group).drop("seed", "slice"))
    parts = rows.groupBy("group").agg(F.ceil(F.count("*") / most).alias("parts")).repartition(F.xxhash64("group"))
    dealt = rows.join(parts.hint("merge"), "group")
    return dealt.withColumn("block", F.xxhash64("group", F.pmod(F.xxhash64("key"), F.col("parts")))).drop("group", "parts")


def centres(blocked: DataFrame) -> DataFrame:
    """One row a block: block, first_at, centre (mean of its unit vectors) and radius."""
    ordered = blocked.select("block", "start_at", "kept").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        now, texts, first = None, [], 0

        def row() -> pa.RecordBatch:
            vectors = unit_rows(texts, memo)
            centre = vectors.mean(axis=0)
            radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([centre.tolist()]), pa.array([radius])], names=["block", "first_at", "centre", "radius"])

        for batch in batches:
            for block, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if texts:
                        yield row()
                    now, texts, first = block, [], at
                texts.append(text)
                first = min(first, at)
        if texts:
            yield row()

    return ordered.mapInArrow(run, "block bigint, first_at bigint, centre array<double>, radius double")


def meetings(scans: DataFrame, summary: DataFrame, least: float = SEEN_LEAST) -> DataFrame:
    """(scan_id, at, text, block) for the blocks in which a check may find an entry like it.

    Centres go to the tasks in groups of about CENTRES; checks stay where they are.
    """
    summary = kept(summary)
    rounds = -(-summary.count() // CENTRES)
    rows = scans.select("scan_id", "at", "text")
    out = None
    for n in range(max(rounds, 1)):
        some = summary.where(F.pmod(F.xxhash64("block"), F.lit(max(rounds, 1))) == n).collect()
        ids, firsts = np.array([r.block for r in some], np.int64), np.array([r.first_at for r in some], np.int64)
        middle, radius = np.array([r.centre for r in some]).reshape(len(some), BUCKETS), np.array([r.radius for r in some])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, firsts=firsts, middle=middle, radius=radius) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in batches:
                for low in range(0, batch.num_rows if len(ids) else 0, 1024):
                    few = batch.slice(low, 1024)
                    bound = unit_rows(few.column(2).to_pylist(), memo) @ middle.T + radius
                    row, block = np.nonzero((bound >= least - 1e-6) & (few.column(1).to_numpy()[:, None] >= firsts))
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in few.columns), pa.array(ids[block])], names=["scan_id", "at", "text", "block"])

        found = rows.mapInArrow(run, "scan_id bigint, at bigint, text string, block bigint")
        out = found if out is None else out.unionByName(found)
    return out


def alike(texts: pa.Array, matrix: np.ndarray, memo: dict, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts that resemble a row of ``matrix`` by ``least``, some at a time, and their cosines with all rows.

    Equal texts meet the matrix once, and those that resemble no row go before times are looked at.
    """
    coded = texts.dictionary_encode()
    which, said = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    for first in range(0, len(said), 512):
        near = np.round(unit_rows(said[first : first + 512], memo) @ matrix.T, DIGITS) + 0.0
        some = np.full(len(said), False)
        some[first : first + len(near)] = (near >= least).any(axis=1)
        rows = np.flatnonzero(some[which])
        for low in range(0, len(rows), 1024):
            part = rows[low : low + 1024]
            yield part, near[which[part] - first]


def resembled(scans: DataFrame, k: int = NEIGHBOURS, least: float = SEEN_LEAST, seconds: int = SLICE) -> DataFrame:
    """Up to ``k`` entries of each block that a check resembles by ``least``: scan_id, at, key, similarity.

    ``scans`` has scan_id, at, key, text and kept. All entries as near as that among the ``k``
    nearest of all are there, as those of each block are.
    """
    blocked = kept(blocks(kept(entries(scans, seconds)), seconds))
    met = meetings(scans, centres(blocked), least)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    left = blocked.select("block", F.lit(0).alias("side"), F.col("start_id").alias("scan_id"), F.col("start_at").alias("at"), F.col("kept").alias("text"), "key", "end_at", "end_id")
    right = met.select("block", F.lit(1).alias("side"), "scan_id", "at", "text", *none("string", "key"), *none("bigint", "end_at", "end_id"))
    # entries by key, so that of equal similarities the smaller key comes first
    stream = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side", "key", "scan_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        now, held, matrix = None, [], None
        for batch in batches:
            block, side = (batch.column(i).to_numpy() for i in (0, 1))
            turns = (np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1).tolist() if batch.num_rows else []
            for low, high in zip([0, *turns], [*turns, batch.num_rows]):
                if low == high:
                    continue
                if block[low] != now:
                    now, held, matrix = block[low], [], None
                if side[low] == 0:
                    held += zip(*(c.to_pylist() for c in batch.slice(low, high - low).columns[2:]))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix = unit_rows([h[2] for h in held], memo)
                    keys = [h[3] for h in held]
                    starts, ids = (np.array([h[i] for h in held], np.int64) for i in (1, 0))
                    ends = np.array([h[4] if h[4] is not None else np.iinfo(np.int64).max for h in held], np.int64)
                    end_ids = np.array([h[5] if h[5] is not None else 0 for h in held], np.int64)
                for at in range(low, high, CHECKS):
                    few = batch.slice(at, min(CHECKS, high - at))
                    for rows, near in alike(few.column(4), matrix, memo, least):
                        when, mine = (few.column(i).to_numpy()[rows][:, None] for i in (3, 2))
                        valid = ((starts < when) | ((starts == when) & (ids < mine))) & ((when < ends) | ((when == ends) & (mine <= end_ids)))
                        near[~valid | (near < least)] = -2
                        order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                        best = np.take_along_axis(near, order, axis=1)
                        row, place = np.nonzero(best > -2)
                        if len(row):
                            columns = [pa.array(mine[row, 0]), pa.array(when[row, 0]), pa.array([keys[i] for i in order[row, place]], pa.string()), pa.array(best[row, place])]
                            yield pa.RecordBatch.from_arrays(columns, names=["scan_id", "at", "key", "similarity"])

    return stream.mapInArrow(run, "scan_id bigint, at bigint, key string, similarity double")


def seen_memory(scans: DataFrame, k: int = NEIGHBOURS, least: float = SEEN_LEAST, seconds: int = SLICE) -> DataFrame:
    """What the memory says of each check: scan_id, seen (number of risky links it resembles), points (20 or 0).

    ``scans`` has scan_id, at (microseconds), key and kept (under which and as what a check is
    remembered), text (what it is compared by), level (its label in the memory) and trusted. An
    entry counts if it is among the ``k`` nearest of reference texts and memory together,
    resembles the check by ``least`` and bears the label suspicious or dangerous at that time.
    Ties go by kind and key. A link of a listed brand has no points. Null texts are empty and
    resemble nothing; rows without a key or a time are not checks.
    """
    usable = scans.where("key is not null and at is not null and scan_id is not null").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("text", "kept")})
    usable = kept(usable.select("scan_id", "at", "key", "text", "kept", "level", "trusted"))
    hits = kept(resembled(usable.where("not trusted").select("scan_id", "at", "key", "text", "kept").unionByName(usable.where("trusted").select("scan_id", "at", "key", F.lit("").alias("text"), "kept")), k, least, seconds))
    order = Window.partitionBy("scan_id").orderBy(F.desc("similarity"), "kind", "key")
    asked = usable.join(hits.select("scan_id").distinct().hint("merge"), "scan_id", "left_semi").select("scan_id", "text")
    texts = nearest(asked.select("text").distinct(), "text", "text", ("brand", "phish"), k).where(F.col("similarity") >= least)
    seeds = asked.join(texts.select("text", "kind", F.col("seed_key").alias("key"), "similarity").hint("merge"), "text").drop("text")
    both = hits.withColumn("kind", F.lit("seen")).unionByName(seeds.withColumn("at", F.lit(None).cast("bigint")))
    top = both.withColumn("place", F.row_number().over(order)).where((F.col("place") <= k) & (F.col("kind") == "seen")).select("scan_id", "at", "key")
    told = last_before(top, usable, "key", "level", seconds)
    risky = told.where(F.col("level").isin("suspicious", "dangerous")).groupBy("scan_id").agg(F.count("*").alias("seen"))
    out = usable.select("scan_id").join(risky.hint("merge"), "scan_id", "left")
    return out.select("scan_id", F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen"), F.when(F.col("seen") > 0, SEEN_POINTS).otherwise(0).alias("points"))
