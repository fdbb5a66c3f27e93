"""Mix sources to target weights by a splitting tree over exact block quotas.

Each source's documents fall into hashed blocks, so a hot source is as spread out
as any other. Its quota is a number of blocks: whole passes over all of them and,
for the rest, blocks in a hashed order. A binary tree over the output shards
splits the quotas by multivariate hypergeometric draws until each leaf is one
shard; each shard then gets a disjoint range of the source's permuted blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint, fresh, words_of
from snarewatch.llm.hypergeometric import draw_multivariate

#: Blocks a source; a window or a group over one block is the largest unit of work.
BLOCKS = 1024
#: Output shards of the mix.
SHARDS = 32
#: Hashed cells of a shard, each shuffled on its own; the most tasks that a shard can use.
CELLS = 4096
#: No source gives more than so many times its size.
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """Targets of sources: shares of the whole by weight, none above ``most`` times its size.

    ``sizes`` has (skey, source, source_size), a row a source. Sources in code-point
    order, null last, take ``weights`` in turn. The excess over a cap goes to the
    others by weight until none is above, which is the level at which the targets
    fill the whole: sources are capped in the order of cap over weight. The windows
    here run over sources, not documents.
    """
    total = Window.partitionBy()
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy("_ratio", "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", cap)
        .withColumn("_ratio", cap / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_fill", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_i", "_level"))).over(total))
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_fill._level") * F.col("_w"), F.col("_cap"))))
        .select("skey", "source", "source_size", "target")
    )


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Recursively split block quotas among shards; returns (skey, shard, n, first).

    ``quotas`` has (skey, n). Every tree node holds one number a source. A node's
    left child draws its exact share of blocks from the node's quotas; the right
    child gets the rest, so quotas and shard sizes (one block apart at most) hold
    exactly. ``first`` is where the shard's range of the source's blocks begins.
    """
    zero = F.lit(0).cast("bigint")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", F.col("n").cast("bigint").alias("n")))).alias("q")).select(
        F.transform("q", lambda x: x["skey"]).alias("keys"),
        F.transform("q", lambda x: x["n"]).alias("n"),
        F.lit(0).alias("lo"),
        F.lit(n_shards).alias("hi"),
    )
    for depth in range(max(0, n_shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        whole = F.aggregate("n", zero, lambda a, x: a + x)
        # blocks before shard j of all shards under this node: evenly cut, one apart
        share = F.floor(whole * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("bigint")
        grown = nodes.withColumn("mid", mid)
        left = F.when(F.col("mid") == F.col("lo"), F.transform("n", lambda x: zero)).otherwise(
            draw_multivariate(F.col("n"), share, F.lit(f"tree {seed}"), F.lit(depth), F.col("lo"))
        )
        grown = grown.withColumn("left", left)
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("n")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("n", "left", lambda x, y: x - y).alias("n")),
        )
        nodes = grown.select("keys", F.explode(halves).alias("h")).select("keys", "h.n", "h.lo", "h.hi").where("hi > lo")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("keys", "n")).alias("x")).select(
        F.col("x.keys").alias("skey"), "shard", F.col("x.n").alias("n")
    )
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), n_shards: int = SHARDS, seed: int = 0, n_blocks: int = BLOCKS
) -> DataFrame:
    """Decide how often each document enters the mix and into which shards.

    Returns a row a document: doc_id, source, size (words), source_size, target,
    taken (size times the copies taken, 0 to 3), shards (array<int>, one a copy).
    A null source is a source of its own. Documents without words have size 0,
    fill no quota and are taken 0 words. Equal rows are rows of their own. Ties of
    the hashed order fall back to id, size and text hash, so reruns agree. No documents
    give no rows.
    """
    text_hash = F.xxhash64("text")
    key = F.xxhash64(F.lit(f"doc {seed}"), F.col("doc_id"), text_hash)
    base = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("size"),
        key.alias("key"),
        F.pmod(F.xxhash64(F.lit(f"block {seed}"), F.col("doc_id"), text_hash), F.lit(n_blocks)).cast("int").alias("block"),
    )
    base = checkpoint(base)

    blocks = base.groupBy("skey", "block").agg(F.sum("size").alias("block_size"), F.first("source").alias("source"))
    sizes = blocks.groupBy("skey").agg(F.first("source").alias("source"), F.sum("block_size").alias("source_size"))
    targets = source_targets(sizes, weights).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    )
    targets = targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    turn = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(f"turn {seed}"), "skey", "block"), "block")
    plan = (
        blocks.drop("source").join(targets.drop("source").hint("merge"), "skey")
        .withColumn("need", F.col("rest") - F.sum("block_size").over(turn) + F.col("block_size"))
        .withColumn("lots", F.col("passes") + F.when(F.col("need") > 0, 1).otherwise(0))
    )
    plan = checkpoint(plan.select("skey", "block", "block_size", "source_size", "target", "passes", "rest", "need", "lots"))

    # each lot is one pass over one block; a source's lots are permuted and cut by shard
    lots = plan.where("lots > 0").select("skey", "block", F.explode(F.sequence(F.lit(1), F.col("lots"))).alias("lot"))
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(f"lot {seed}"), "skey", "block", "lot"), "block", "lot")
    ranked = lots.withColumn("at", (F.row_number().over(permuted) - 1).cast("bigint"))
    quotas = plan.groupBy("skey").agg(F.sum("lots").alias("n"))
    ranges = split_quotas(quotas, n_shards, seed).where("n > 0")
    places = ranges.select("skey", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))
    homes = (
        ranked.join(places.hint("merge"), ["skey", "at"])
        .groupBy("skey", "block")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("lot", "shard"))), lambda x: x["shard"]).alias("homes"))
    )
    plan = plan.join(homes.hint("merge"), ["skey", "block"], "left")

    # row by row: equal rows have places of their own, as each fits or not by itself
    within = Window.partitionBy("skey", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # in the block where the rest runs out, documents are taken while they fit
    fits = (F.col("need") > 0) & (F.sum("size").over(within) <= F.col("need"))
    taken = (
        base.join(plan.hint("merge"), ["skey", "block"])
        .withColumn("part", F.when(fits & (F.col("size") > 0), 1).otherwise(0))
        .withColumn("place", F.count("*").over(within))
        .select("doc_id", "source", "skey", "key", "block", "place", "size", "source_size", "target", "passes", "rest", "part", "homes")
    )
    taken = checkpoint(taken)

    # what a source still lacks is filled by single documents: the largest that fits, again and
    # again, at most one of each size; then one more, if going over by it comes nearer
    gaps = taken.groupBy("skey").agg((F.first("rest") - F.sum(F.col("size") * F.col("part"))).alias("gap"))
    offers = taken.where("part = 0 and size > 0 and passes < 3").groupBy("skey", "size").agg(
        F.min(F.struct("key", "doc_id", "block", "place")).alias("who")
    )
    offers = checkpoint(offers.join(gaps.hint("merge"), "skey").where("gap > 0 and size < 2 * gap"))
    # one number for each size below twice the gap; a size is a count of words of one document
    sizes = offers.groupBy("skey").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list("size"), asc=False).alias("sizes"))
    start = F.struct(F.array().cast("array<bigint>").alias("picked"), F.col("gap").alias("left"))

    def fill(a: Column, size: Column) -> Column:
        return F.when(size <= a["left"], F.struct(F.concat(a["picked"], F.array(size)).alias("picked"), (a["left"] - size).alias("left"))).otherwise(a)

    filled = sizes.select("skey", "sizes", F.aggregate("sizes", start, fill).alias("f"))
    over = F.array_min(F.filter(F.array_except("sizes", "f.picked"), lambda x: (x > F.col("f.left")) & (x - F.col("f.left") < F.col("f.left"))))
    picked = filled.select("skey", F.explode(F.array_compact(F.concat("f.picked", F.array(over)))).alias("size"))
    extra = (
        offers.join(picked.hint("merge"), ["skey", "size"])
        .select("skey", F.col("who.block").alias("block"), F.col("who.place").alias("place"), F.lit(1).alias("extra"))
    )
    out = taken.join(extra.hint("merge"), ["skey", "block", "place"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("part") + F.col("extra")).otherwise(0)
    # an extra document outside the last block taken gets a hashed shard
    spare = F.pmod(F.xxhash64(F.lit(f"spare {seed}"), "key"), F.lit(n_shards)).cast("int")
    homes = F.concat(F.coalesce("homes", F.array().cast("array<int>")), F.array(spare))
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("bigint").alias("taken"),
        F.slice(homes, F.lit(1), copies.cast("int")).alias("shards"),
    )


def mixed_documents(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: a row a copy, columns of ``docs``, each shard's cells shuffled locally.

    ``plan`` is ``mix_sources(docs)`` and is matched by doc_id; rows that share a
    doc_id must be told apart beforehand. Documents that the mix leaves out are gone.
    Columns of ``docs`` besides doc_id are passed on whatever their names.
    """
    whole, key, shards, shard, order, cell = fresh(docs.select("doc_id"), "row", "key", "shards", "shard", "order", "cell")
    picks = plan.where("size(shards) > 0").select(F.col("doc_id").alias(key), F.col("shards").alias(shards))
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    rows = rows.join(picks.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key))).withColumn(shard, F.explode(shards))
    rows = rows.withColumn(order, F.xxhash64(F.lit(f"local {seed}"), "doc_id", shard)).withColumn(cell, F.pmod(order, F.lit(CELLS)))
    placed = rows.repartition(shard, cell).sortWithinPartitions(shard, order)
    return placed.select(f"{whole}.*")
