"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's shingles are ordered by a fixed rule that puts those of frequent cells
of a count sketch last. If two sets are as similar as asked, their prefixes of
``n - ceil(t * n) + m`` shingles share at least ``m``; every document picks the m
that its own prefix's estimated candidates make cheapest, and a pair must share the
smaller of its two numbers. Only such pairs are verified, on their whole sets.

Copies are one class throughout. Links are found in two rounds: first between the
documents that share a prefix shingle and the one of them with most copies, or the
one before them; then between all candidates that are not yet in one component. A
large group of near copies is joined up in the first round, at a cost linear in its
size, and nothing that could link two components is left out in the second. A
sketch of parities, whose distance no difference of sets can fall short of, rules
most pairs out before texts move; where many documents share a shingle they are
compared by it block against block, so that pairs ruled out never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.llm.common import FILTER_BITS, alone, bit_filter, checkpoint, collected, connected_components, passes, written

#: Cells of the count sketch; 2 MB at the driver and 1 MB in each worker, whatever the corpus.
CELLS = 1 << 18
#: Rows in which a task's sketch travels.
PIECES = 64
#: Most shared prefix shingles that a document may ask for.
MOST_SHARED = 4
#: Cost of reading a candidate from the index, beside one verification.
READ_COST = 0.05
#: Bits of the odd sketch that bounds from below in how much two sets differ.
ODD_BITS = 2048
#: Classes under one shingle from which on pairs are compared in blocks, not as rows.
MANY = 64
#: Classes of a block in which sketches are compared, pair by pair, in one task.
BLOCK = 1024
#: Words whose hash a task remembers, and sets whose digest it does.
MEMO = 100_000
#: Sets under one shingle, as estimated, from which on they are dealt out in parts.
SPLIT = 4096
#: Partners of one class that one task compares it with.
PARTNERS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of the words that a task has met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased.

    A shorter text is one run of all its words; without words the set is empty.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - take + 1, take, np.uint64)
        for i in range(take):
            out = _scramble(out * _MIX + h[i : len(h) - take + 1 + i])
    return np.unique(out)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(shingles.tobytes(), seed) for seed in (1, 2)))


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of ODD_BITS cells.

    A shingle that only one of two sets has flips one bit, so the sketches differ in
    at most as many bits as the sets differ in shingles.
    """
    flips = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % ODD_BITS, minlength=ODD_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _survey(width: int):
    """Per row its set's size, fingerprint and odd sketch; per task its counts, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, memo = np.zeros(CELLS, np.int32), _Words()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        schema = pa.schema(list(zip(("doc_id", "th", "n", "f1", "f2", "odd", "piece", "counts"), kinds, strict=True)))
        for batch in batches:
            rows = []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), width, memo)
                np.add.at(sketch, (shingles & np.uint64(CELLS - 1)).astype(np.int64), 1)
                rows.append((len(shingles), *_fingerprint(shingles), odd_sketch(shingles)))
            if rows:
                found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[2:6], strict=True)]
                none = [pa.nulls(len(rows)).cast(k) for k in kinds[6:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found, *none], schema=schema)
        if sketch.any():
            parts = [p.tobytes() for p in np.split(sketch, PIECES)]
            none = [pa.nulls(PIECES).cast(k) for k in kinds[:6]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the pieces that one task meets, in any order."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.frombuffer(counts, np.int32).astype(np.int64)
            total[piece] = total[piece] + found if piece in total else found
    for piece, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["piece", "counts"])


def corpus_sketch(pieces: DataFrame) -> np.ndarray:
    """The whole corpus's sketch: CELLS counts at the driver, a fixed size."""
    summed = pieces.select("piece", "counts").repartition(PIECES, "piece").mapInArrow(alone(_add_up), "piece int, counts binary")
    out = np.zeros(CELLS, np.int64)
    each = CELLS // PIECES
    for row in collected(summed):
        out[row.piece * each : (row.piece + 1) * each] += np.frombuffer(row.counts, np.int64)
    return out


def heat_of(sketch: np.ndarray) -> np.ndarray:
    """Documents by which a cell is above what chance fills it with; 0 for most cells."""
    mean = sketch.mean()
    return np.maximum(sketch - mean - 4 * math.sqrt(mean) - 1, 0).astype(np.float32)


def choose_prefix(shingles: np.ndarray, heat: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The prefix a document is indexed under, and how many of it a partner must share."""
    n = len(shingles)
    need = math.ceil(threshold * n - 1e-9)
    h = heat[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    level = np.ceil(np.log2(1 + h)).astype(np.uint64)
    order = np.lexsort((shingles, level))
    cost = np.cumsum(h[order])
    best, shared = math.inf, 1
    for m in range(1, min(MOST_SHARED, need) + 1):
        reads = cost[n - need + m - 1]
        now = READ_COST * (reads + n - need + m) + reads / m
        if now < best:
            best, shared = now, m
    return shingles[order[: n - need + shared]], shared


def _index(width: int, threshold: float, heat):
    """Rows (token, cell, doc_id, th, n, shared): a set under each shingle of its prefix.

    ``cell`` is the number of parts that the shingle's sets are dealt to, by its
    estimated count, and this set's part: 2^32 * parts + part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen, memo = heat.value, set(), _Words()
        names = ["token", "cell", "doc_id", "th", "n", "shared"]
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            tokens, cells, lengths, rows = [], [], [], []
            for doc_id, th, text in keys:
                if doc_id is None:
                    continue
                shingles = shingle_set(text.as_py(), width, memo)
                mark = xxhash.xxh128_digest(shingles.tobytes())
                if not len(shingles) or mark in seen:
                    continue  # one of the copies that a task meets shortly after each other stands for all
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(mark)
                prefix, shared = choose_prefix(shingles, weights, threshold)
                of = 1 + (weights[(prefix & np.uint64(CELLS - 1)).astype(np.int64)] / SPLIT).astype(np.int64)
                tokens.append(prefix.view(np.int64))
                cells.append((of << 32) + int.from_bytes(mark[:4], "big") % of)
                lengths.append(len(prefix))
                rows.append((doc_id, th, len(shingles), shared))
            if rows:
                columns = [np.repeat(np.array(c, np.int64), lengths) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(cells)), *map(pa.array, columns)], names=names)

    return run


def _pack(asked):
    """Rows (doc_id, th, packed) of texts that may be asked for, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, squeeze, seen = asked.value, zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            bit = batch.column(3).to_numpy()
            few = batch.take(pa.array(np.flatnonzero(passes(bits, bit))))
            keep = []
            for i, key in enumerate(zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True)):
                if len(seen) >= MEMO:
                    seen.clear()
                if key not in seen:  # repeated rows go once
                    seen.add(key)
                    keep.append(i)
            few = few.take(pa.array(keep, pa.int64()))
            texts = [squeeze((t.as_py() or "").encode()) for t in few.column(2)]
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(texts, pa.binary())], names=["doc_id", "th", "packed"])

    return run


def _verify(width: int, threshold: float):
    """Rows (a, b, packed text of b), those of one a together and its own first, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, memo = None, None, _Words()
        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            links = []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                other = shingle_set(open_up(packed.as_py()).decode(), width, memo)
                if a == b:
                    at, own = a, other
                    continue
                assert a == at, "a class's own text comes first"
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= round(100 * threshold) * (len(own) + len(other) - both):
                    links.append((a, b))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough.

    Each pair takes b's text to a; a task streams through a's partners, or a part of
    them where there are many, and holds two sets. ``pairs`` is checkpointed by the
    caller. A bit filter of fixed size, which may let through more but never less,
    keeps most other texts at home.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("of")).where("of > 1")
    dealt = pairs.join(many.hint("merge"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("of", F.lit(1))).alias("part"))
    dealt = dealt.unionByName(dealt.select("a", F.col("a").alias("b"), "part").distinct())
    asked = checkpoint(dealt.join(classes.select(F.col("node").alias("b"), "doc_id", "th").hint("merge"), "b"))
    bit = F.pmod(F.xxhash64("doc_id", "th"), F.lit(FILTER_BITS))
    shared = bit_filter(asked, bit)
    texts = docs.where("doc_id is not null").select("doc_id", "th", "text", bit.alias("bit")).mapInArrow(alone(_pack(shared)), "doc_id bigint, th bigint, packed binary")
    met = asked.hint("merge").join(texts, ["doc_id", "th"]).select("a", "part", "b", "packed", (F.col("a") != F.col("b")).alias("other"))
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", "other", "b").select("a", "b", "packed")
    return met.mapInArrow(alone(_verify(width, threshold)), "a bigint, b bigint")


def _not_too_odd(threshold: float):
    """Sorted rows of blocks that meet in, pairs (a, b) that may be similar out.

    Sets of n and m shingles as similar as asked differ in at most
    (1 - t) / (1 + t) * (n + m) of them, and their sketches in no more bits.
    """
    share = (1 - threshold) / (1 + threshold)

    def pairs(rows: pa.Table) -> list[pa.RecordBatch]:
        node, n, home, side = (rows.column(c).to_numpy() for c in ("node", "n", "home", "side"))
        odd = np.frombuffer(b"".join(rows.column("odd").to_pylist()), np.uint64).reshape(len(node), -1)
        same = rows.column("block")[0].as_py() == rows.column("with")[0].as_py()
        left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        out = []
        for at in range(0, len(left), 32):
            i = left[at : at + 32]
            apart = np.bitwise_count(odd[i][:, None, :] ^ odd[right][None, :, :]).sum(axis=2, dtype=np.int32)
            sizes = n[i][:, None] + n[right][None, :]
            near = np.minimum(n[i][:, None], n[right][None, :]) >= np.maximum(n[i][:, None], n[right][None, :]) * threshold - 1e-6
            fine = near & (apart <= share * sizes + 1e-6) & (home[i][:, None] != home[right][None, :])
            x, y = np.nonzero(fine)
            x, y = i[x], right[y]
            keep = x < y if same else np.ones(len(x), bool)
            one, two = node[x[keep]], node[y[keep]]
            out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("token", "block", "with")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    mark = tuple(marks[low])
                    if held and mark != last:
                        yield from pairs(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(batch.slice(low, high - low))
                    last = mark
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) under one shingle and of different homes that sketches cannot rule out.

    ``members`` has token, node, n, home, odd and of, the number of blocks into which
    the token's classes are cut. Each block meets itself and every other one in a
    task of its own; what is shuffled is sketches, and no row stands for a pair that
    is ruled out.
    """
    placed = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("of") - 1),
        lambda b: F.struct(F.least(b, F.col("mine")).alias("block"), F.greatest(b, F.col("mine")).alias("with"), (F.col("mine") > b).cast("int").alias("side")),
    )
    rows = placed.select("token", "node", "n", "home", "odd", F.explode(meets).alias("m")).select("token", "m.block", "m.with", "m.side", "node", "n", "home", "odd")
    place = ["token", "block", "with"]
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(alone(_not_too_odd(threshold)), "a bigint, b bigint").distinct()


def _sifted(pairs: DataFrame, odd: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow them to be similar."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n), ODD_BITS // 64) for i in (3, 5))
            fine = pa.array(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= share * (n + m) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(fine) for i in (0, 1)], names=["a", "b"])

    one, two = (odd.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "n_a", "odd_a", "n_b", "odd_b")
    return both.mapInArrow(alone(run), "a bigint, b bigint")


def similar_documents(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets.

    Returns doc_id, n_shingles, component_id (the smallest id in reach, its own
    included), a row a row of ``docs``. Documents link when 100 * |both| >=
    100 * threshold * |either|, with the threshold in whole hundredths. A null,
    empty or blank text has no shingles and links with nothing. Rows with shingles
    that share an id are one document: each of its texts links, and all are in one
    component. A null id is never linked. Columns besides doc_id and text are not
    read; no documents give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text")
    survey_ddl = "doc_id bigint, th bigint, n bigint, f1 bigint, f2 bigint, odd binary, piece int, counts binary"
    survey = written(docs.select("doc_id", "th", "text").mapInArrow(alone(_survey(width)), survey_ddl))
    heat = spark.sparkContext.broadcast(heat_of(corpus_sketch(survey.where("piece is not null"))))
    sets = survey.where("piece is null").select("doc_id", "th", "n", "f1", "f2")
    # a class is a set, whatever its documents' ids; one of its rows stands for it
    usable = survey.where("piece is null and n > 0 and doc_id is not null")
    stands = F.min(F.struct("doc_id", "th"))
    classes = usable.groupBy("f1", "f2").agg(stands.alias("row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("odd").alias("odd"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "row.doc_id", "row.th", "copies", "n", "odd"))
    member = usable.select("doc_id", "th", "f1", "f2").join(classes.select("f1", "f2", "node", "copies").hint("merge"), ["f1", "f2"])
    member = written(member.select("doc_id", "th", "node", "copies").distinct())
    odd = classes.select("node", "n", "odd")

    # classes under each shingle of their prefix; a shingle of one class alone is of no use
    parts = F.shiftright("cell", 32)
    turn = Window.partitionBy("token", "cell").orderBy("doc_id", "th")
    index = docs.select("doc_id", "th", "text").mapInArrow(alone(_index(width, threshold, heat)), "token bigint, cell bigint, doc_id bigint, th bigint, n bigint, shared bigint")
    index = index.select("*", F.lag("doc_id").over(turn).alias("last"), F.lead("doc_id").over(turn).alias("next"))
    index = index.where((parts > 1) | F.col("last").isNotNull() | F.col("next").isNotNull()).drop("last", "next")
    index = (
        index.hint("merge").join(member, ["doc_id", "th"])
        .repartition("token", "cell").groupBy("token", "cell", "node")
        .agg(F.first("n").alias("n"), F.min("shared").alias("shared"), F.max("copies").alias("copies"))
    )
    # with each, the one of most copies in its part and the one before it
    turn = Window.partitionBy("token", "cell").orderBy(F.desc("copies"), "node")
    other = F.struct("node", "n", "shared")
    index = index.select("*", F.first(other).over(turn).alias("hub"), F.lag(other).over(turn).alias("last"), F.lead("node").over(turn).alias("next"))
    index = written(index.where((parts > 1) | F.col("last").isNotNull() | F.col("next").isNotNull()).drop("next"))
    # the first ones of a shingle's parts meet in turn
    turn = Window.partitionBy("token").orderBy(F.desc("copies"), "node")
    firsts = index.where((parts > 1) & (F.col("hub.node") == F.col("node"))).drop("last")
    firsts = firsts.withColumn("hub", F.first(other).over(turn)).withColumn("last", F.lag(other).over(turn))

    def near(n: str, m: str):
        return F.least(n, m) >= F.greatest(n, m) * threshold - 1e-6

    def candidates(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")

    def meet(rows: DataFrame, one: str) -> DataFrame:
        met = rows.where(f"{one} is not null and {one}.node <> node").where(near("n", f"{one}.n"))
        return met.select(F.least("node", f"{one}.node").alias("a"), F.greatest("node", f"{one}.node").alias("b"), F.least("shared", f"{one}.shared").alias("need"))

    first = meet(index, "hub").unionByName(meet(index, "last")).unionByName(meet(firsts, "hub")).unionByName(meet(firsts, "last"))
    first = checkpoint(candidates(first))
    asked = checkpoint(_sifted(first, odd, threshold))
    # sets that share an id are linked by it
    apart = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    bound = member.select("doc_id", F.col("node").alias("b")).join(apart.hint("merge"), "doc_id").where("a <> b").select("a", "b")
    edges = checkpoint(_links(docs, classes, asked, width, threshold).unionByName(bound))
    home = connected_components(edges)
    placed = (
        index.select("token", "node", "n").hint("merge").join(home.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("home", F.coalesce("component", "node")).drop("component")
    )
    # shingles whose classes are all in one component have nothing left to tell
    mixed = placed.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("m")).where("low <> high").select("token", "m")
    rest = written(placed.join(mixed.hint("merge"), "token").select("token", "node", "n", "home", "m"))
    few = rest.where(F.col("m") <= MANY)
    one, two = (few.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "home")]) for side in "xy")
    cross = one.hint("merge").join(two, "token").where("home_x <> home_y and node_x < node_y").where(near("n_x", "n_y"))
    # a pair may meet under frequent shingles as well, so here one meeting is enough
    small = cross.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct().join(first.hint("merge"), ["a", "b"], "left_anti")
    many = rest.where(F.col("m") > MANY).withColumn("of", F.ceil(F.col("m") / BLOCK).cast("int")).join(odd.drop("n").hint("merge"), "node")
    large = _across(many, threshold).join(first.hint("merge"), ["a", "b"], "left_anti")
    second = checkpoint(_sifted(small, odd, threshold).unionByName(large).distinct())
    more = checkpoint(_links(docs, classes, second, width, threshold))
    final = connected_components(edges.unionByName(more)).withColumnRenamed("id", "node")
    told = classes.select("node", "f1", "f2", "doc_id").join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = told.groupBy("component").agg(F.min("doc_id").alias("component_id")).repartition("component_id")
    told = told.select("f1", "f2", "component").join(least.hint("merge"), "component").select("f1", "f2", "component_id")
    whole = sets.join(told.hint("merge"), ["f1", "f2"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(own, F.col("component_id")), "doc_id").alias("component_id"))
