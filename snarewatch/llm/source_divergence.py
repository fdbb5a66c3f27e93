"""How the sources of a language differ in their words: single-pass indexing, then pair corrections.

Each task builds the postings of its block of documents in memory, and when they reach a
bound puts them out as a run sorted by term. Runs are dealt by a hash of language and term,
each shard is merged in term order (Spark's sort spills its own runs to disk and merges
them by heap), and one pass over a shard adds up the runs of a term to its frequency in
every source. Divergences need no dense table of terms and sources: for each pair of sources
there is a value as if no term occurred, a correction for each source that depends on how
many of its terms have which probability, and a correction for each term that both have,
which is streamed from the postings and added up by pair. All numbers are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.llm.common import written

#: Postings that a task holds before it puts out a run, some 150 MB.
POSTINGS = 400_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 22
#: Pairs of sources whose corrections a task holds before it adds them up by pair.
PAIRS = 1_000_000
#: Groups (language, source) up to which their totals are broadcast, some 10 MB.
FEW_GROUPS = 100_000
#: Sources of a language in a batch up to which its terms are one table of numbers.
FEW_SOURCES = 64
#: Probabilities are numbers of 1 to SCALE + 1.
SCALE = 1_000_000_000
#: Ranks of the terms that a group uses more than its language.
TOP = 10
#: Every byte that belongs to a term stays, A-Z as a-z; any other is a blank. Bytes from 0x80 on are letters of other scripts.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8: runs of letters A-Z, a-z and all that is not ASCII, A-Z lower-cased.

    Long texts are cut at blanks, so that a text's terms are never all held at once.
    """
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = end if end >= 0 else len(folded)
        yield folded[at:end].split()
        at = end


def index_runs(docs: DataFrame, most: int = POSTINGS) -> DataFrame:
    """Postings (lang, term, source, n, docs) of blocks of documents, each block sorted by term.

    ``n`` counts occurrences, ``docs`` documents. A block ends when it holds ``most``
    postings. A document without terms leaves none.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    kept = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text)
    names = ["lang", "term", "source", "n", "docs"]

    def put_out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for (lang, source), (ns, docs) in held.items():
            terms = pa.array(list(ns), pa.binary()).cast(pa.string())
            counts = [pa.array(np.fromiter(x, np.int64, len(ns))) for x in (ns.values(), map(docs.__getitem__, ns))]
            parts.append(pa.table([pa.repeat(lang, len(ns)), terms, pa.repeat(source, len(ns)), *counts], names=names))
        if parts:
            table = pa.concat_tables(parts)
            yield from table.take(pc.sort_indices(table, [(c, "ascending") for c in names[:3]])).combine_chunks().to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ns, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(ns)
                mine: set[bytes] = set()
                for terms in terms_of(text.as_py()):
                    ns.update(terms)
                    mine.update(terms)
                docs.update(mine)
                size += len(ns)
                if size >= most:
                    yield from put_out(held)
                    held, size = {}, 0
        yield from put_out(held)

    return kept.mapInArrow(run, "lang string, term string, source string, n bigint, docs bigint")


def merged(runs: DataFrame, least_docs: int) -> DataFrame:
    """One row a term of ``least_docs`` documents or more: lang, term, sources (sorted), ns (occurrences in each).

    Shards go by (lang, term); a pass over a sorted shard holds the terms of a batch. What a task
    has of a term are its runs by source, so a term that every document has is no hot key.
    """
    ordered = runs.repartition(F.col("lang"), F.col("term")).sortWithinPartitions("lang", "term", "source")
    out = ["lang", "term", "sources", "ns"]

    def begins(table: pa.Table, *columns: str) -> np.ndarray:
        """The rows that differ from the row before in one of the columns."""
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            value = table.column(c).combine_chunks()
            new[1:] |= pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def lists(table: pa.Table) -> pa.RecordBatch | None:
        """The rows of whole terms as a row a term."""
        at = begins(table, "lang", "term")
        enough = np.add.reduceat(table.column("docs").to_numpy(), at) >= least_docs
        table = table.filter(pa.array(np.repeat(enough, np.diff(np.append(at, table.num_rows)))))
        if not table.num_rows:
            return None
        pairs = begins(table, "lang", "term", "source")
        ns = np.add.reduceat(table.column("n").to_numpy(), pairs)
        table = table.take(pa.array(pairs)).combine_chunks()
        at = begins(table, "lang", "term")
        offsets = pa.array(np.append(at, table.num_rows).astype(np.int32))
        one = table.select(["lang", "term"]).take(pa.array(at)).combine_chunks()
        column = lambda t, c: t.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [column(one, "lang"), column(one, "term"), pa.ListArray.from_arrays(offsets, column(table, "source")), pa.ListArray.from_arrays(offsets, pa.array(ns))], names=out
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the last term, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            last = int(begins(table, "lang", "term")[-1])
            if last and (found := lists(table.slice(0, last))) is not None:
                yield found
            rest = table.slice(last).to_batches()
        if rest and (found := lists(pa.Table.from_batches(rest))) is not None:
            yield found

    return ordered.mapInArrow(run, "lang string, term string, sources array<string>, ns array<bigint>")


def _small(df: DataFrame) -> str:
    """How a table of groups is joined: broadcast up to FEW_GROUPS rows, by shuffle beyond."""
    return "broadcast" if df.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else "merge"


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact whatever the counts."""
    long = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), long(total + terms * 2))
    return (whole + 1).cast("bigint")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the square is at most 10^18."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(postings: DataFrame, most: int = PAIRS) -> DataFrame:
    """Corrections for terms that two sources share: lang, a, b, value, both ways round.

    ``postings`` has lang, sources, ps (probabilities where the term occurs) and zeros
    (those of the same sources where no term does). A task adds up by pair whenever it
    holds ``most`` corrections, and puts out sums when they are as many themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[tuple[str, str], int]] = {}
        size = 0

        def put_out() -> Iterator[pa.RecordBatch]:
            rows = [(lang, a, b, v) for lang, by in sums.items() for (a, b), v in by.items()]
            for at in range(0, len(rows), 50_000):
                lang, a, b, v = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.int64())], names=["lang", "a", "b", "value"])

        def add(lang: str, sources: list[str], p: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Corrections of terms (rows of ``p``) in sources (columns); where one has no term ``p`` is as ``z``, and nothing comes of it."""
            nonlocal sums, size
            by = sums.setdefault(lang, {})
            step = max(1, PAIRS // (len(sources) + 1))
            for k, a in enumerate(sources[:-1]):
                rest, value = slice(k + 1, None), 0
                for at in range(0, len(p), step):
                    one, two = p[at : at + step, k : k + 1], p[at : at + step, rest]
                    value += (_gap(one, two) - _gap(one, z[rest]) - _gap(z[k], two) + _gap(z[k], z[rest])).sum(axis=0)
                for b, v in zip(sources[k + 1 :], value.tolist()):
                    size += (a, b) not in by
                    by[a, b] = by.get((a, b), 0) + v
                if size >= most:
                    yield from put_out()
                    sums, size = {}, 0
                    by = sums.setdefault(lang, {})

        for batch in batches:
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy()))
            coded = batch.column(1).flatten().dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            ps, zs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                rows = np.flatnonzero(langs == lang)
                at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in rows])
                mine = sorted(set(codes[at].tolist()), key=names.__getitem__)
                if len(mine) <= FEW_SOURCES:
                    place = np.zeros(len(names), np.int64)
                    place[mine] = np.arange(len(mine))
                    z = np.ones(len(mine), np.int64)
                    z[place[codes[at]]] = zs[at]
                    p = np.repeat(z[None], len(rows), axis=0)
                    p[np.repeat(np.arange(len(rows)), np.diff(ends)[rows]), place[codes[at]]] = ps[at]
                    yield from add(lang, [names[c] for c in mine], p, z)
                    continue
                # of many sources a term has few: terms go by the sources that they have
                alike: dict[bytes, list[int]] = {}
                for i in rows:
                    alike.setdefault(codes[ends[i] : ends[i + 1]].tobytes(), []).append(ends[i])
                for key, starts in alike.items():
                    own = np.frombuffer(key, codes.dtype)
                    if len(own) > 1:
                        yield from add(lang, [names[c] for c in own], ps[np.array(starts)[:, None] + np.arange(len(own))], zs[starts[0] : starts[0] + len(own)])
        yield from put_out()

    half = postings.select("lang", "sources", "ps", "zeros").mapInArrow(run, "lang string, a string, b string, value bigint")
    half = half.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def own_terms(groups: DataFrame, flat: DataFrame) -> DataFrame:
    """What every pair would be if its sources shared no term: lang, a, b, value, a row a side.

    ``groups`` has lang, source, zero and terms (number of kept terms of the language),
    ``flat`` lang, source, p of each kept term in each source. The terms of a source count
    by their probability; how many those are is bounded by how many counts there are. A
    pass over a source's rows holds them and streams the other sources of the language.
    """
    hist = flat.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))
    hist = hist.select("lang", "a", F.lit(0).alias("side"), F.lit(None).cast("string").alias("b"), "p", "m", F.lit(None).cast("bigint").alias("terms"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("q"))
    pairs = groups.join(two.hint("merge"), "lang").where("source <> b")
    pairs = pairs.select("lang", F.col("source").alias("a"), F.lit(1).alias("side"), "b", F.col("zero").alias("p"), F.col("q").alias("m"), "terms")
    ordered = hist.unionByName(pairs).repartition(F.col("lang"), F.col("a")).sortWithinPartitions("lang", "a", "side", "b", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts = None, [], []
        for batch in batches:
            lang, a, side, b, p, m, terms = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if (lang[i], a[i]) != now:
                    now, held, counts = (lang[i], a[i]), [], []
                if side[i] == 0:
                    held.append(p[i])
                    counts.append(m[i])
                    continue
                if isinstance(held, list):
                    held, counts = np.array(held, np.int64), np.array(counts, np.int64)
                zero, other = p[i], m[i]
                base = int(_gap(np.int64(zero), np.int64(other)))
                change = int(((_gap(held, np.int64(other)) - base) * counts).sum())
                # half of the value without terms belongs to each side; odd ones to the first
                whole = base * terms[i]
                mine = whole - whole // 2 if a[i] < b[i] else whole // 2
                out.append((lang[i], a[i], b[i], mine + change))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "a", "b", "value"])

    sided = ordered.mapInArrow(run, "lang string, a string, b string, value bigint")
    return sided.unionByName(sided.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def divergences(docs: DataFrame, least_docs: int = 10, top: int = TOP, most: int = POSTINGS) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that mark each source.

    Returns lang, source, part (``pair`` or ``term``), item, value, rank, as the contract of
    ``op13`` states them. ``docs`` has text, lang, source; nulls are empty strings, other
    columns are not read, every row is a document. A language without kept terms has pairs of
    value 0 and no terms. No documents give no rows.
    """
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    occurring = written(named.distinct())
    kept = written(merged(index_runs(docs, most), least_docs))
    flat = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "ns")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.ns").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals.hint("merge"), ["lang", "source"], "left").join(terms.hint("merge"), "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, probability(zero, F.col("total"), F.col("terms"))).otherwise(1))
    groups = written(groups)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    groups = written(groups.join(whole.hint("merge"), "lang"))
    how = _small(groups)
    seen = kept.select("lang", "term", F.aggregate("ns", zero, lambda a, x: a + x).alias("all_n"), F.explode(F.arrays_zip("sources", "ns")).alias("x"))
    seen = seen.select("lang", "term", "all_n", F.col("x.sources").alias("source"), F.col("x.ns").alias("n")).join(groups.hint(how), ["lang", "source"])
    seen = written(seen.select("lang", "term", "source", "zero", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), probability(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q")))

    over = seen.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    entry = F.sort_array(F.collect_list(F.struct("source", "p", "zero")))
    postings = seen.groupBy("lang", "term").agg(entry.alias("e")).select("lang", F.col("e.source").alias("sources"), F.col("e.p").alias("ps"), F.col("e.zero").alias("zeros"))
    values = own_terms(groups.select("lang", "source", "zero", "terms"), seen).unionByName(shared_terms(postings))
    pairs = values.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(marks, "term"))
