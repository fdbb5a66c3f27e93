"""Quality rules: fixed text rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs hash into a fixed number of buckets. Two multinomials over
the buckets, one of trusted documents and one of the whole corpus, give each
bucket a log ratio; a document's verdict is its length-normalised sum against a
threshold. That is a fixed margin below the mean of trusted documents held back
from the fit, so it means the same for a small corpus, whose ratios are noisy, as
for a large one. All of it is DataFrame expressions: one pass counts, one scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint, let, words_of

#: Buckets of the hashed n-grams; bounds the model whatever the corpus.
BUCKETS = 1 << 16
#: At most so many trusted documents fit the target model, those of lowest hash.
TRUSTED_ROWS = 50_000
#: Weight, in features, of the corpus prior behind the target model.
PRIOR = 65_536
#: Features of ratio one added to every document, so that short texts need more evidence.
PAD = 40
#: One in so many trusted documents is held back to place the threshold.
HELD_BACK = 10
#: Documents whose mean log ratio is so far below that of held-back trusted ones go.
MARGIN = 0.2
#: Log ratios are held in millionths, which makes every sum exact.
SCALE = 1_000_000


def _pairs(h: Column, apart: int) -> Column:
    """Hashes of h[i] with h[i + apart], for each i that has both."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(windows: Column, width: int = 8) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array."""

    def covered(ranked: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            near = (F.get(ranked, i + 1)["h"] == x["h"], F.get(ranked, i - 1)["h"] == x["h"])
            return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

        at = F.sort_array(F.transform(F.filter(ranked, twice), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(i, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(ranked, covered))


def with_hashes(docs: DataFrame) -> DataFrame:
    """Add _words (array), _h1 and _h2 (hashes of words and of neighbouring words)."""
    return (
        docs.withColumn("_words", words_of(F.col("text")))
        .withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_h2", _pairs(F.col("_h1"), 1))
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: int = PRIOR) -> DataFrame:
    """One row, ratios array<bigint>: per bucket, ln of target over corpus in millionths.

    Corpus counts cover every document; target counts cover documents whose id is
    in ``trusted`` (bounded by the caller). The corpus model, worth ``prior``
    features, backs the target model, so a bucket without evidence has ratio one.
    The aggregate is by bucket: each task sends at most ``buckets`` rows.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).distinct().withColumn("_good", F.lit(1))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left")
    features = with_hashes(marked).select(
        F.coalesce("_good", F.lit(0)).alias("target"), F.explode(F.concat("_h1", "_h2")).alias("h")
    )
    seen = features.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("raw"), "target")
    zero = F.lit(0)
    # every bucket once more with nothing, so that position in the result equals bucket
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), zero.alias("raw"), zero.alias("target"))
    counts = seen.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    one = counts.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
    )

    def ratio(x: Column) -> Column:
        odds = (x["target"] * F.col("n_raw") / x["raw"] + prior) / (F.col("n_target") + prior)
        return F.when(x["raw"] == 0, F.lit(0).cast("bigint")).otherwise(F.round(F.ln(odds) * SCALE).cast("bigint"))

    return one.select(F.transform("rows", ratio).alias("ratios"))


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good and not toxic: at most ``rows``, by lowest hash."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _scored(docs: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    score = lambda h: F.aggregate(
        h, F.lit(0).cast("bigint"), lambda a, x: a + F.get(F.col("_ratios"), F.pmod(x, F.lit(buckets)).cast("int"))
    )
    return (
        with_hashes(docs)
        .withColumn("_ratios", model.scalar())
        .withColumn("_sum", score(F.col("_h1")) + score(F.col("_h2")))
        .withColumn("llr", F.col("_sum") / SCALE / (F.size("_h1") + F.size("_h2") + PAD))
    )


def _judged(docs: DataFrame, trusted: DataFrame, margin: float, buckets: int) -> DataFrame:
    """The verdict columns added to ``docs``, whose other names must not clash with them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(HELD_BACK)) == 0
    # 512 kB of ratios, written once for the two passes that use them
    model = checkpoint(log_ratios(docs, trusted.where(~held), buckets))
    ids = trusted.where(held).select(F.col("doc_id").alias("_id")).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    level = _scored(sample, model, buckets).where("size(_words) >= 20").agg(F.avg("llr"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = (
        _scored(docs, model, buckets)
        .withColumn("_h4", _pairs(F.col("_h2"), 2))
        .withColumn("_h8", _pairs(F.col("_h4"), 4))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col("_h8")))
        .withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.coalesce(level.scalar(), F.lit(0.0)) - margin))
    )
    return judged.drop("_words", "_h1", "_h2", "_h4", "_h8", "_lines", "_ratios", "_sum")


def judge_quality(docs: DataFrame, trusted: DataFrame, margin: float = MARGIN, buckets: int = BUCKETS) -> DataFrame:
    """Verdicts on every document, a row a row of ``docs``.

    ``trusted`` (doc_id) is a bounded sample; a tenth of it, by hash, places the
    threshold and the rest fits the target model. Returns doc_id, text, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), llr (double, mean log
    ratio), base_failed and kept (boolean). A null or blank text has no words and fails
    the base rules. Without trusted documents every ratio is one and only the base
    rules decide. Repeated rows get equal verdicts; no documents give no rows. Other
    columns of ``docs`` are not read.
    """
    return _judged(docs.select("doc_id", "text"), trusted, margin, buckets)


def good_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that ``judge_quality`` keeps, with the columns of ``docs`` as they are.

    Those travel packed, so that none is taken for a verdict, whatever its name. The
    row number keeps the filter above the projections: pushed below them, it would
    hold the whole chain of word and window hashes many times over.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"))
    judged = _judged(rows, trusted, MARGIN, BUCKETS).withColumn("_row", F.monotonically_increasing_id())
    return judged.where("kept and _row >= 0").select("_docs.*")
