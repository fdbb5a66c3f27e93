"""Nearest neighbours by counting collisions in windows around the query's projections.

Every vector is projected on ``m`` random lines. A block of vectors holds each line's
projections as one sorted array; around a query's own projection a window is opened in every
array, and a vector that lies in enough of the windows is verified by its distance. Windows
widen from round to round with the radius (virtual rehashing: the arrays stay as they are),
for those queries alone that have not yet found ``k`` vectors within the radius.

A vector within the radius lies in a window with a chance of P1 at least, so it is missed
with a chance of MISS at most, and a query is done only when its k-th distance is within the
radius. A last round looks at everything, for queries that no radius has served.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.llm.common import written

#: By this factor the radius grows in a round; at twice the radius fewer windows hold a vector.
GROWTH, APART = 1.5, 2.0
#: Chance at most that a vector within the radius is not verified.
MISS = 0.02
#: Width of a window at radius 1, the best for APART, and the chances that it holds a vector at 1 and at APART.
WIDTH = math.sqrt(8 * APART**2 * math.log(APART) / (APART**2 - 1))
P1, P2 = (math.erf(WIDTH / 2 / r / math.sqrt(2)) for r in (1, APART))
#: Numbers that a block of vectors holds, 16 MB as doubles; its arrays take as much for 64 of them a vector.
BLOCK = 1 << 21
#: The least vectors of a block where there are several, and blocks of a small table.
LEAST_BLOCK, BLOCKS = 1024, 12
#: Queries and vectors of the sample that sets the first radius.
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 4096
#: Lengths of vectors up to which their sizes are broadcast.
FEW_LENGTHS = 10_000


def lines_for(n: int) -> tuple[int, int]:
    """(lines, collisions): how many projections ``n`` vectors need, and how many windows ask for verification.

    By Hoeffding's bound a vector within the radius is verified but for a chance of MISS, and
    of those beyond APART times the radius a hundred on average at most.
    """
    false = math.sqrt(math.log(2 * max(n, 100) / 100))
    missed = math.sqrt(math.log(1 / MISS))
    lines = math.ceil((false + missed) ** 2 / (2 * (P1 - P2) ** 2))
    share = (false / missed * P1 + P2) / (1 + false / missed)
    return lines, math.ceil(share * lines)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (row, vec_id, v, length) that can be compared, written once.

    Null ids, and vectors that are null, empty, zero or hold a null or non-finite number,
    take no part. ``row`` tells rows of one id apart.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return written(good.withColumn("length", F.size("v")))


def first_radius(rows: DataFrame, k: int) -> float | None:
    """A low k-th distance among a bounded sample: SAMPLE_QUERIES queries, SAMPLE_ROWS vectors.

    None if the sample has no positive distance. It sets where rounds begin, not what they find.
    """
    sample = [np.array(r.v) for r in rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE_ROWS).select("v").collect()]
    lengths = {len(v) for v in sample}
    kth = []
    for length in lengths:
        same = np.array([v for v in sample if len(v) == length])
        for v in same[:SAMPLE_QUERIES]:
            far = np.sort(np.sqrt(((same - v) ** 2).sum(axis=1)))
            far = far[far > 0]
            if len(far):
                kth.append(far[min(k, len(far)) - 1])
    return float(np.quantile(kth, 0.1)) if kth else None


class SortedArrays:
    """One block: vectors with their ids, and a sorted array of projections for each line."""

    def __init__(self, rows: list[int], ids: list[int], vectors: np.ndarray, lines: int) -> None:
        # by id, so that of equal distances the smaller id comes first
        order = np.lexsort((np.array(rows, np.int64), np.array(ids, np.int64)))
        self.rows, self.ids, self.vectors = np.array(rows, np.int64)[order], np.array(ids, np.int64)[order], vectors[order]
        self.axes = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], lines))
        at = (self.vectors @ self.axes).T
        self.order = at.argsort(axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def search(self, queries: np.ndarray, own: np.ndarray, radius: float, collisions: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (number, places, distances) of its nearest ``k`` verified within ``radius``."""
        centre, half = queries @ self.axes, WIDTH * radius / 2
        low = np.array([np.searchsorted(a, centre[:, i] - half, "left") for i, a in enumerate(self.sorted)])
        high = np.array([np.searchsorted(a, centre[:, i] + half, "right") for i, a in enumerate(self.sorted)])
        for q in range(len(queries)):
            if math.isinf(radius):
                found = np.arange(len(self.ids))
            elif np.count_nonzero(high[:, q] > low[:, q]) < collisions:
                continue
            else:
                met = np.concatenate([o[a:b] for o, a, b in zip(self.order, low[:, q], high[:, q])])
                found = np.flatnonzero(np.bincount(met, minlength=len(self.ids)) >= collisions)
            found = found[self.rows[found] != own[q]]
            far = np.sqrt(((self.vectors[found] - queries[q]) ** 2).sum(axis=1))
            near = np.flatnonzero(far <= radius)
            if len(near) > k:
                # all at the k-th distance stay until the stable sort, which goes by id
                near = near[far[near] <= np.partition(far[near], k - 1)[k - 1]]
            near = near[far[near].argsort(kind="stable")][:k]
            if len(near):
                yield q, found[near], far[near]


def search_round(rows: DataFrame, queries: DataFrame, radius: float, lines: int, collisions: int, k: int) -> DataFrame:
    """Verified vectors within ``radius`` of each query: query_row, query_id, vec_id, score, row.

    ``rows`` has block besides the columns of ``usable``, ``queries`` is exploded over the
    blocks. A task's stream is sorted so that a block's vectors come before the queries
    that it is asked for, and holds one block and one batch of queries.
    """
    columns = ["length", "block", "side", "row", "vec_id", "v"]
    side = lambda df, n: df.withColumn("side", F.lit(n)).select(columns)
    stream = side(rows, 0).unionByName(side(queries, 1)).repartition(F.col("length"), F.col("block")).sortWithinPartitions("length", "block", "side", "row")
    names = ["query_row", "query_id", "vec_id", "score", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, arrays = None, [], None
        for batch in batches:
            length, block, kind, row, vec_id = (batch.column(i).to_numpy() for i in range(5))
            # a batch in pieces of one block and one side
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (length[a], block[a]) != now:
                    now, held, arrays = (length[a], block[a]), [], None
                part = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, length[a])
                if kind[a] == 0:
                    held.append((row[a:b], vec_id[a:b], part))
                    continue
                if arrays is None and held:
                    arrays = SortedArrays(*(np.concatenate([h[i] for h in held]) for i in range(2)), np.concatenate([h[2] for h in held]), lines)
                    held = []
                if arrays is None:
                    continue
                for q in range(0, b - a, 256):
                    few = slice(a + q, min(a + q + 256, b))
                    out = [(row[few][i], vec_id[few][i], arrays.ids[at], far, arrays.rows[at]) for i, at, far in arrays.search(part[q : q + 256], row[few], radius, collisions, k)]
                    if out:
                        sizes = [len(o[3]) for o in out]
                        columns = [np.repeat([o[i] for o in out], sizes) for i in (0, 1)] + [np.concatenate([o[i] for o in out]) for i in (2, 3, 4)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return stream.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score double, row bigint")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest vectors of every row for which ``queries`` holds: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are not read. Nearness is Euclidean
    distance in double precision, ties go to the smaller vec_id. A row is no neighbour of
    itself, but rows of its id are; a repeated query row has an answer of its own. Vectors
    of different lengths are not compared. With fewer than ``k`` other vectors a query gets
    them all. What takes no part is said in ``usable``. No queries give no rows.
    """
    rows = usable(vectors)
    n = rows.count()
    lines, collisions = lines_for(n)
    blocks = F.greatest(F.ceil(F.col("n") * F.col("length") / block), F.least(F.lit(BLOCKS), F.floor(F.col("n") / LEAST_BLOCK)), F.lit(1)).cast("int")
    sizes = rows.groupBy("length").agg(F.count("*").alias("n")).select("length", blocks.alias("blocks"))
    how = "broadcast" if sizes.limit(FEW_LENGTHS + 1).count() <= FEW_LENGTHS else "merge"
    wide = rows.join(sizes.hint(how), "length")
    dealt = wide.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    left = written(wide.where(queries))
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    radius, last = first_radius(rows, k), 2 * math.sqrt(most or 0.0)
    found = []
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    while left.limit(1).count():
        radius = math.inf if radius is None or radius >= last else radius
        asked = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        near = search_round(dealt, asked, radius, lines, collisions, k)
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        got = written(ranked.select("query_row", "query_id", "rank", "vec_id", "score"))
        if math.isinf(radius):
            found.append(got)
            break
        done = got.where(F.col("rank") == k).select(F.col("query_row").alias("row"))
        found.append(got.join(done.hint("merge"), got["query_row"] == done["row"], "left_semi"))
        left = written(left.join(done.hint("merge"), "row", "left_anti"))
        radius *= GROWTH
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("query_id", "rank", "vec_id", "score")
