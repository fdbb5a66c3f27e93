"""Embedding near-duplicates: random-hyperplane tables, exact cosines, components.

Signs of random projections give each vector a bucket in every table. Only ids and a
code of at most CODE signs go to every table: there, codes that differ too much for the
threshold are sifted out, and vectors follow to the buckets where a partner is left.
Those are compared exactly, block against block. Equal vectors are one class throughout.
Nothing pair-sized leaves a task: a bucket sends on, per class, a count of the links
that were first met in it and one edge of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint, connected_components

#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-5
#: Signs of a code, and the chance that the codes of a pair exactly at the threshold differ too much.
CODE, CODE_MISS = 256, 1e-6
#: Classes that a bucket of independent vectors is meant to hold.
BUCKET = 64
#: Rows of a block; a larger bucket is compared as pairs of blocks in tasks of their own.
BLOCK = 2048


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET of ``n`` vectors, misses below MISS."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(max(4, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4), 30)
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def code_plan(bits: int, tables: int, threshold: float) -> tuple[int, int]:
    """(tables, signs): whole tables that a code covers, signs in which a pair may differ."""
    covered = max(1, min(tables, CODE // bits))
    n, p = covered * bits, math.acos(threshold) / math.pi
    beyond, most = 1.0, -1
    while beyond > CODE_MISS and most < n:
        most += 1
        beyond -= math.comb(n, most) * p**most * (1 - p) ** (n - most)
    return covered, most


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite part and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _signatures(bits: int, tables: int, covered: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((batch.num_rows, tables), np.int32)
            codes = np.zeros((batch.num_rows, -(-covered * bits // 8)), np.uint8)
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                at = np.flatnonzero(sizes == dim)
                rows = _unit(flat[starts[at][:, None] + np.arange(dim)])
                signs = (rows @ planes[dim] > 0).reshape(len(at), tables, bits)
                keys[at] = signs @ weights
                codes[at] = np.packbits(signs[:, :covered].reshape(len(at), covered * bits), axis=1)
            offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, packed], names=[*batch.schema.names, "keys", "code"])

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position in reach of each of ``n`` positions over links i-j."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _sides(table: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a block meets itself, and the rows to hold against each other."""
    column = lambda c: table.column(c).combine_chunks().to_numpy()
    same = bool(column("block")[0] == column("with")[0])
    left = np.arange(table.num_rows) if same else np.flatnonzero(column("side") == 0)
    return same, left, left if same else np.flatnonzero(column("side") == 1)


def _first_met(keys: np.ndarray, number: int, rows: np.ndarray, least: float, sides: tuple[bool, np.ndarray, np.ndarray]):
    """Positions (a, b) of products of ``least`` or more whose keys all differ before table ``number``."""
    same, left, right = sides
    for at in range(0, len(left), 512):
        a, b = np.nonzero(rows[left[at : at + 512]] @ rows[right].T >= least)
        a, b = left[at + a], right[b]
        keep = a < b if same else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        for low in range(0, len(a), 100_000):
            x, y = a[low : low + 100_000], b[low : low + 100_000]
            first = ~(keys[x, :number] == keys[y, :number]).any(axis=1)
            yield x[first], y[first]


def _each_meeting(where: list[str], work):
    """``work`` on each run of rows alike in ``where``, over the sorted batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = np.column_stack([batch.column(c).to_numpy() for c in where])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                mark = tuple(marks[low])
                if held and mark != last:
                    if (out := work(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(low, high - low))
                last = mark
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _sift(bits: int, covered: int, most: int):
    """Which codes of a meeting have a partner that differs in ``most`` signs at most and was not met before."""

    def near(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        signs = np.unpackbits(codes, axis=1, count=covered * bits)
        keys = signs.reshape(-1, covered, bits) @ (1 << np.arange(bits, dtype=np.int64))
        number = int(table.column("table").to_numpy().min())
        hit = np.zeros(table.num_rows, bool)
        # a product of signs is their number less twice the differing ones
        for a, b in _first_met(keys, number, signs.astype(np.float32) * 2 - 1, covered * bits - 2 * most, _sides(table)):
            hit[a] = hit[b] = True
        if not hit.any():
            return None
        return pa.Table.to_batches(table.select(["id", "table", "block", "with", "side"]).filter(pa.array(hit)).combine_chunks())[0]

    return _each_meeting(["place", "block", "with"], near)


def _compare(threshold: float):
    """Vectors that meet in; per class its first-met links and a forest edge out."""

    def links(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        column = lambda c: table.column(c).combine_chunks()
        ids, n = column("id").to_numpy(), column("n").to_numpy()
        vectors = column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = _unit(vectors.reshape(table.num_rows, -1))
        keys = column("keys").flatten().to_numpy().reshape(table.num_rows, -1)
        found = list(_first_met(keys, int(column("table")[0].as_py()), rows, threshold, _sides(table)))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        if not len(a):
            return None
        count = np.bincount(a, weights=n[b], minlength=len(ids)) + np.bincount(b, weights=n[a], minlength=len(ids))
        root = _forest(len(ids), a, b)
        hit = np.flatnonzero(count > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(count[hit].astype(np.int64)), pa.array(ids[root[hit]])], names=["id", "links", "other"]
        )

    return _each_meeting(["label", "dim", "table", "key", "block", "with"], links)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, seed: int = 0) -> DataFrame:
    """Links of cosine ``threshold`` or more between vectors of one label.

    Reads vec_id, embedding and label. Returns vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id in reach, its own included) and kept
    (component_id = vec_id), a row a row. A vector that is null, empty, all zero or
    holds a null or non-finite part, or whose label is null, links with nothing; so
    do vectors of different length. Equal vectors link with each other; repeated
    rows count as vectors of their own. No vectors give no rows.
    """
    read = vectors.select(
        F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.col("embedding").alias("vector"),
    )
    good = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    prints = [F.when(good, F.xxhash64(F.lit(i), "vector")).alias(f"f{i}") for i in (1, 2)]
    marked = read.select("vec_id", "label", *prints, F.when(good, F.col("vector")).alias("vector"))
    key = ["label", "f1", "f2"]
    classes = checkpoint(
        marked.where("f1 is not null").groupBy(*key).agg(
            F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")
        )
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    kind = classes.schema["vector"].dataType.simpleString()
    rows = classes.select("id", "label", "n", F.size("vector").alias("dim"), "vector")
    covered, most = code_plan(bits, tables, threshold)
    sign = _signatures(bits, tables, covered, seed)
    signed = checkpoint(rows.mapInArrow(sign, f"id bigint, label bigint, n bigint, dim int, vector {kind}, keys array<int>, code binary"))

    bucket = ["label", "dim", "table", "key"]
    narrow = signed.select("id", "label", "dim", F.posexplode("keys").alias("table", "key"))
    large = narrow.groupBy(*bucket).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    in_large = (
        narrow.join(large.hint("merge"), bucket)
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("table", F.ceil(F.col("rows") / BLOCK).cast("int")))).alias("parts"))
    )
    coded = signed.select("id", "label", "dim", "keys", "code").join(in_large.hint("merge"), "id", "left")
    parts = F.coalesce(F.element_at("parts", F.col("table")), F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.col("of")).cast("int")
    # each block meets itself and every other block once: side 0 is the lower block
    meets = F.transform(
        F.sequence(F.lit(0), F.col("of") - 1),
        lambda b: F.struct(
            F.least(b, F.col("mine")).alias("block"), F.greatest(b, F.col("mine")).alias("with"), (F.col("mine") > b).cast("int").alias("side")
        ),
    )
    spread = (
        coded.select("*", F.posexplode("keys").alias("table", "key")).withColumn("of", parts).withColumn("mine", mine)
        .select(F.xxhash64(*bucket).alias("place"), "id", "code", "table", F.explode(meets).alias("meet"))
        .select("place", "id", "code", "table", "meet.*")
    )
    place = ["place", "block", "with"]
    wanted = spread.repartition(*place).sortWithinPartitions(*place)
    wanted = wanted.mapInArrow(_sift(bits, covered, most), "id bigint, table int, block int, with int, side int")
    place = [*bucket, "block", "with"]
    sent = (
        wanted.join(signed.drop("code").hint("merge"), "id")
        .withColumn("key", F.element_at("keys", F.col("table") + 1))
    )
    met = sent.repartition(*place).sortWithinPartitions(*place).mapInArrow(_compare(threshold), "id bigint, links bigint, other bigint")
    met = checkpoint(met)

    joined = connected_components(met.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        classes.select(*key, "id", "n")
        .join(links.hint("merge"), "id", "left")
        .join(joined.hint("merge"), "id", "left")
        .select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return (
        marked.drop("vector").join(known.hint("merge"), key, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
