"""What filters do to a corpus in every order: failing-id relations and semi and anti joins.

Each filter has a table of the rows that fail it. The rows of one filter's table that
survive a set of other filters are what a left-anti join with each of their tables
leaves; what the matching left-semi join finds is redundant, as an earlier filter has
removed it. A filter's removals depend on the set of filters before it alone, so sixteen
sets for each of five filters say all about 120 orders. Sets are built up letter by
letter, and documents that fail nothing are counted, never joined.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint, ensure_checkpoint_dir, let, words_of, written

FILTERS = "ABCDE"
#: Characters that fail filter D.
SYMBOLS = "[#$%&*|]"


def failed_by_text(text: Column) -> Column:
    """Numbers (0 to 3) of the filters A to D that a text fails.

    Fewer than 50 words; fewer than 65 distinct words in a hundred; more than 5
    capitals A-Z in a hundred characters; a symbol.
    """
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words)
        rules = (
            n < 50,
            F.size(F.array_distinct(words)).cast("bigint") * 100 < n.cast("bigint") * 65,
            F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 5,
            text.rlike(SYMBOLS),
        )
        return F.array_compact(F.array(*[F.when(r, F.lit(i)) for i, r in enumerate(rules)]))

    return let(words_of(text), of)


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id of the table has; ``rows`` has h1, h2 of texts.

    Rows of one id and text don't fail through each other; a null id is neither smaller
    nor larger than another. Only texts that occur again meet their rows, and the minima
    are dealt anew, so that a text of a third of all rows is split over many tasks.
    """
    least = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = least.repartition(F.xxhash64("h1", "h2"))
    return rows.join(least.hint("merge"), ["h1", "h2"]).where("doc_id > least").drop("least")


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of each part, failing ids): (part, n) and (filter, row, part, good, toxic).

    ``row`` tells rows apart, whatever their doc_id. A filter's table is the folder of
    its number. Of several labels of an id one that says good or toxic is enough; labels
    meet failing rows alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
            F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), failed_by_text(F.col("text")).alias("failed"),
        )
    )
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    by_text = rows.select("row", "doc_id", "part", F.explode("failed").alias("filter"))
    by_copy = later_copies(rows.drop("failed")).select("row", "doc_id", "part", F.lit(FILTERS.index("E")).alias("filter"))
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = told.where("good or toxic").repartition(F.xxhash64("doc_id"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    fails = by_text.unionByName(by_copy).join(told.hint("merge"), "doc_id", "left").select("filter", "row", "part", flag("good"), flag("toxic"))
    return parts, id_tables(fails)


def id_tables(fails: DataFrame) -> DataFrame:
    """Write one table a filter below the shared checkpoint folder, and read them as one."""
    ensure_checkpoint_dir(fails.sparkSession)
    path = f"{fails.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/failing-{uuid.uuid4().hex}"
    fails.write.partitionBy("filter").parquet(path)
    return fails.sparkSession.read.schema(fails.schema).parquet(path)


def removals(fails: DataFrame) -> DataFrame:
    """What each filter removes after each set of others: part, set, filter, removed, met, good_lost, toxic_lost.

    ``set`` has a bit for each filter passed before. ``removed`` counts the rows of the
    filter's table that left-anti joins with the tables of the set leave; ``met`` those
    that the last of these joins, as a left-semi one, finds removed already. Sets grow by
    letters in order, so each set is met once, and each round joins all of them at once.
    """
    n, bit = len(FILTERS), lambda c: F.call_function("shiftleft", F.lit(1), F.col(c))
    known = fails.select(F.col("filter").alias("next"), "row")
    left, out = fails.withColumn("set", F.lit(0)), []
    for size in range(n):
        counts = left.groupBy("part", "set", "filter").agg(
            F.count("*").alias("removed"), F.lit(0).cast("bigint").alias("met"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")
        )
        out.append(checkpoint(counts))
        if size == n - 1:
            break
        # the letters after the last of the set, but for the filter itself
        letters = F.filter(F.lit(list(range(n))), lambda i: (F.call_function("shiftright", F.col("set"), i) == 0) & (i != F.col("filter")))
        tested = left.withColumn("next", F.explode(letters))
        met = tested.join(known.hint("merge"), ["next", "row"], "left_semi").groupBy("part", (F.col("set") + bit("next")).alias("set"), "filter").agg(F.count("*").alias("met"))
        zero = F.lit(0).cast("bigint")
        out.append(checkpoint(met.select("part", "set", "filter", zero.alias("removed"), "met", zero.alias("good_lost"), zero.alias("toxic_lost"))))
        passed = tested.join(known.hint("merge"), ["next", "row"], "left_anti").withColumn("set", F.col("set") + bit("next")).drop("next")
        left = written(passed.select("filter", "row", "part", "good", "toxic", "set")) if size < n - 2 else passed
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("part", "set", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "met", "good_lost", "toxic_lost")])


def _steps() -> str:
    """Every step of every order as JSON: what to look up for it. 600 entries, whatever the input."""
    key = lambda s, f: s * 8 + f
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before, chain, gone = order[:step], [], 0
            for g in sorted(before):  # the set as ``removals`` grows it
                gone |= 1 << g
                chain.append(key(gone, f))
            sums = [sum(1 << g for g in order[:i]) for i in range(step + 1)]
            others = sum(1 << g for g in order if g != f)
            out.append({
                "filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "filter": f, "own": key(sums[-1], f), "met": chain,
                "gone": [key(s, g) for s, g in zip(sums, order)], "alone": key(others, f),
            })
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order and step of the five filters, 600 rows a part.

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, as the contract of ``op11`` states them. ``docs`` has
    doc_id, text, source, ``labels`` doc_id, quality, toxic; other columns are not read.
    A null text is empty, a null source the empty string; every row counts, rows with
    equal ids as well; a row without an id has no labels. No documents give no rows.
    """
    parts, fails = failing_ids(docs, labels)
    counted = removals(fails)
    weight = F.element_at(F.lit([math.factorial(k) * math.factorial(4 - k) for k in range(5)]), F.bit_count("set") + 1)
    entry = F.struct("removed", "met", "good_lost", "toxic_lost", "filter", (F.col("removed") * weight).alias("shares"))
    # at most 80 entries a part
    by_part = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("set") * 8 + F.col("filter"), entry))).alias("m"))
    shape = "array<struct<filter_order:string,step:int,filter:int,own:int,met:array<int>,gone:array<int>,alone:int>>"
    steps = parts.join(by_part.hint("merge"), "part", "left").select("part", "n", "m", F.explode(F.from_json(F.lit(_steps()), shape)).alias("s"))
    zero = F.lit(0).cast("bigint")
    at = lambda k, c: F.coalesce(F.try_element_at("m", k)[c], zero)
    total = lambda keys, c: F.aggregate(keys, zero, lambda a, k: a + at(k, c))
    shares = F.aggregate(F.filter(F.coalesce(F.map_values("m"), F.array()), lambda e: e["filter"] == F.col("s.filter")), zero, lambda a, e: a + e["shares"])
    return steps.select(
        "part", "s.filter_order", "s.step", F.substring(F.lit(FILTERS), F.col("s.filter") + 1, F.lit(1)).alias("filter"),
        (F.col("n") - total(F.col("s.gone"), "removed")).alias("kept"), at(F.col("s.own"), "removed").alias("removed"),
        total(F.col("s.met"), "met").alias("redundant"), at(F.col("s.alone"), "removed").alias("unique_fails"),
        at(F.col("s.own"), "good_lost").alias("good_lost"), at(F.col("s.own"), "toxic_lost").alias("toxic_lost"), shares.alias("shapley"),
    )
