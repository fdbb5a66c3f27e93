"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into virtual partitions by hash, so a retried task meets the same rows.
The matrix of partition-to-shard counts is drawn with both margins fixed. Each
partition is permuted on its own and dealt out by its row of the matrix; each
shard is then permuted again, in hashed cells whose offsets make one gapless
numbering. No task ever holds a shard or a partition in memory, only sorts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint, let
from snarewatch.llm.hypergeometric import draw_multivariate

#: Virtual partitions; a square, as the matrix is drawn in groups of their root.
PARTITIONS = 1024
#: Cells into which each shard's second permutation is cut.
CELLS = 1024


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int = 0, n_parts: int = PARTITIONS) -> DataFrame:
    """Draw how many rows each partition sends to each shard.

    ``sizes`` has (part int, n bigint) with at most one row a partition. Returns
    (part, counts array<bigint>) for all partitions; each row sums to the
    partition's size and each shard's total differs from another's by at most one.
    The matrix is drawn for groups of partitions first, then within each group, so
    ``n_parts`` x ``n_shards`` numbers are all that is ever gathered.
    """
    root = int(n_parts**0.5)
    if root * root != n_parts:
        raise ValueError("n_parts must be a square number")
    spark = sizes.sparkSession
    zero = F.lit(0).cast("bigint")
    every = spark.range(n_parts).select(F.col("id").cast("int").alias("part"), zero.alias("n"))
    filled = sizes.select("part", "n").unionByName(every).groupBy("part").agg(F.sum("n").alias("n"))
    groups = filled.groupBy(F.floor(F.col("part") / root).cast("int").alias("g")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "n"))), lambda x: x["n"]).alias("parts")
    )

    def deal(members: Column, capacity: Column, *key: Column) -> Column:
        """One draw a member from what the members before it left of ``capacity``."""
        start = F.struct(F.array().cast("array<array<bigint>>").alias("out"), capacity.alias("left"))

        def member(a: Column, n: Column) -> Column:
            drawn = draw_multivariate(a["left"], n, F.lit(seed), *key, F.size(a["out"]))
            return let(
                drawn,
                lambda d: F.struct(
                    F.concat(a["out"], F.array(d)).alias("out"), F.zip_with(a["left"], d, lambda x, y: x - y).alias("left")
                ),
            )

        return F.aggregate(members, start, member, lambda a: a["out"])

    total = F.aggregate("sizes", zero, lambda a, x: a + x)
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda j: F.floor(F.col("n") / n_shards) + F.when(j < F.col("n") % n_shards, 1).otherwise(0),
    )
    top = (
        groups.select("g", "parts", F.aggregate("parts", zero, lambda a, x: a + x).alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("g", "n", "parts"))).alias("all"))
        .select("all", F.transform("all", lambda x: x["n"]).alias("sizes"))
        .withColumn("n", total)
        .select("all", deal(F.col("sizes"), shares, F.lit("group")).alias("capacity"))
        .select(F.explode(F.arrays_zip("all", "capacity")).alias("x"))
        .select("x.all.g", "x.all.parts", "x.capacity")
        .repartition(root, "g")
    )
    low = top.select("g", F.posexplode(deal(F.col("parts"), F.col("capacity"), F.col("g"))).alias("i", "counts"))
    return low.select((F.col("g") * root + F.col("i")).cast("int").alias("part"), "counts")


def shuffle_into_shards(
    rows: DataFrame, key: list[str], n_shards: int, seed: int = 0, n_parts: int = PARTITIONS, cells: int = CELLS
) -> DataFrame:
    """Add shard (int) and slot (bigint, gapless from 0 in each shard) to narrow rows.

    ``key`` names the columns that tell rows apart; rows equal in all of them are
    interchangeable. Null keys are keys like any other. No rows give no rows.
    """
    spare = {"_part", "_rank", "_shard", "_cell", "_again", "shard", "slot"} & set(rows.columns)
    if spare:
        raise ValueError(f"rename {sorted(spare)} first")
    order = [F.col(c) for c in key]
    first = F.xxhash64(F.lit(f"first {seed}"), *order)
    rows = checkpoint(rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(f"part {seed}"), *order), F.lit(n_parts)).cast("int")))
    sizes = rows.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, n_shards, seed, n_parts)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    ends = matrix.select(
        F.col("part").alias("_part"),
        F.aggregate(
            "counts", start,
            lambda a, n: F.struct(F.concat(a["out"], F.array(a["at"] + n)).alias("out"), (a["at"] + n).alias("at")),
            lambda a: a["out"],
        ).alias("_ends"),
    )
    within = Window.partitionBy("_part").orderBy(first, *order)
    again = F.xxhash64(F.lit(f"second {seed}"), *order)
    # ends has n_parts rows of n_shards numbers, whatever the input: a proven bound
    dealt = (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(ends), "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))
        .withColumn("_again", again)
        .withColumn("_cell", F.pmod(F.col("_again"), F.lit(cells)).cast("int"))
        .drop("_part", "_rank", "_ends")
    )
    dealt = checkpoint(dealt)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "_cell").agg(F.count("*").alias("n"))
        .withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    # at most n_shards x cells rows of three numbers: a proven bound
    cell = Window.partitionBy("shard", "_cell").orderBy("_again", *order)
    return (
        dealt.withColumn("_rank", F.row_number().over(cell) - 1)
        .join(F.broadcast(offsets), ["shard", "_cell"])
        .withColumn("slot", (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_cell", "_again", "_rank", "_offset")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """Put documents into shards under the law ``rows``: counts at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard,
    slot, grown_shard (null under this law). A null text has no bytes and the
    checksum of no bytes. Repeated rows and rows with equal ids are rows of their
    own; columns besides doc_id and text are not read. No documents give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = shuffle_into_shards(narrow, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
