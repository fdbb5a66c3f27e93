"""What several operators of this folder share: words, checkpoints, components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A run of these characters parts two words: blank, tab, line feed, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a filter that keeps rows nobody asked for out of a shuffle: 2 MB.
FILTER_BITS = 1 << 24
#: Spark's setting by which a query's shuffle files go as it ends, not once the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this worker keeps for later tasks of one operator.
_KEPT: dict[tuple, object] = {}


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for expressions inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; make one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoints-")
    sc.setCheckpointDir(shared)


def hold(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, kept in this worker for its later tasks until one of another operator comes."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give up what this worker keeps."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, in a worker that first gives up what it keeps for other operators.

    Spark's workers go from task to task and end only after a minute without one, so
    what an operator keeps would be held through all stages of the next.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)

    return begin


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries made in here leave no shuffle files when they end; a part that is lost is made again."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def collected(df: DataFrame) -> list[Row]:
    """The few rows of ``df``, whose shuffle files go."""
    with _shuffles_go(df.sparkSession):
        return df.select("*").collect()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from what was written."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    For large rows: a fraction of the size that ``checkpoint`` takes.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bit_filter(rows: DataFrame, at: Column) -> Broadcast:
    """FILTER_BITS bits, sent to every task, of which those at ``at`` of all rows are set.

    A fixed size, whatever the rows: what is in them passes the filter, what is not may.
    """
    parts = rows.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in collected(parts):
        bits[(row.part - 1) * 4096 : row.part * 4096] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are set."""
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to the wanted ones that no column of ``df`` has, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b).

    Returns (id, component) for each id that has an edge to another id; component
    is the smallest id in reach. Alternates large-star and small-star rounds; a
    round that changes nothing ends it. Each round is checkpointed, so a lost
    executor costs one round at most. The minima are dealt anew before they meet the
    edges, as adaptive execution splits a hot id only where both sides of a join come
    straight from a shuffle.
    """
    now = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        mark = collected(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))))
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.repartition(F.xxhash64("u")).hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.repartition(F.xxhash64("u")).hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
