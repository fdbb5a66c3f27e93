"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snarewatch.llm import bpe, common, jaccard_join, mixing, pii, quality_rules

#: Keys of repeated rows up to which they are broadcast, some 5 MB.
KNOWN = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; labels of good documents fit the target model.

    A null text has no words and is rejected, as an empty one is; rows of equal id are
    judged each by its own text; no documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.good_documents(docs, quality_rules.trusted_sample(labels))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id.

    Rows of equal id and text are one document, of which the row whose hash is smallest
    stays; rows of equal id alone are one document of several texts; rows without an id
    are kept, texts without words as well. No documents give none.
    """
    found = jaccard_join.similar_documents(docs.select("doc_id", "text"), width=5, threshold=0.8)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    (row,) = common.fresh(docs, "row")
    first = told_apart(docs.where("doc_id is not null"), row).where(F.col(row).endswith(":1")).drop(row)
    named = first.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text.

    A null text stays null and an empty one empty; every row is masked for itself.
    """
    masked = pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def told_apart(docs: DataFrame, name: str) -> DataFrame:
    """Add ``name``: id, text hash and occurrence number, so rows of one id or of none differ.

    Only rows whose id and text occur again are shuffled to be numbered. Their keys, 16
    bytes a document, are counted first; few of them are broadcast, many are joined.
    Numbers go by the hash of the whole row; rows equal in all columns are interchangeable
    and numbered by the task that wrote them, so that many copies fall to many tasks.
    """
    key, more, whole, at, before = common.fresh(docs, "key", "more", "whole", "at", "before")
    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text").cast("string")))
    again = common.written(keyed.groupBy(key).count().where("count > 1").select(key, F.lit(True).alias(more)))
    few = again.limit(KNOWN + 1).count() <= KNOWN
    keyed = keyed.join(again.hint("broadcast" if few else "merge"), key, "left")
    once = keyed.where(F.col(more).isNull()).withColumn(name, F.concat(key, F.lit(":1")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = common.written(keyed.where(F.col(more).isNotNull()).drop(more).withColumn(whole, F.xxhash64(*columns)).withColumn(at, F.spark_partition_id()))
    cell = [key, whole, at]
    earlier = Window.partitionBy(key).orderBy(whole, at).rowsBetween(Window.unboundedPreceding, -1)
    cells = repeated.groupBy(*cell).count().withColumn(before, F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    turn = F.col(before) + F.row_number().over(Window.partitionBy(*cell).orderBy(whole))
    numbered = repeated.join(cells.hint("merge"), cell).withColumn(name, F.concat(key, F.lit(":"), turn.cast("string")))
    return once.unionByName(numbered, allowMissingColumns=True).select(*columns, name)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; each row counts for itself."""
    row, own = common.fresh(docs, "row", "own")
    rows = told_apart(docs, row)
    plan = mixing.mix_sources(rows.select(F.col(row).alias("doc_id"), "source", "text"))
    mixed = mixing.mixed_documents(rows.withColumnRenamed("doc_id", own).withColumnRenamed(row, "doc_id"), plan)
    return mixed.drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to.

    A null text is empty and has no tokens; every row is encoded for itself.
    """
    import public_tokenizers

    return bpe.round_trip(docs, bpe.ship_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express hashed ratios, components by similarity or merges; the operators are
#: tested against brute force instead, and of the stages the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
