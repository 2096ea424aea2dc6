"""The corpus pipeline: five stages over ``documents``, each applying one operator to what its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read
again as the next stage's documents. SQL cannot express the stages, so ``ORACLE_SQL`` is None and the
tests compare every stage with a brute-force version.

Null texts are empty: the quality rules reject them. Rows without id pass; those that repeat a row's id and
text are rows of their own up to the near copies, where one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import packing, quality_classifier, suffix_dedup
from tickloom.llm.common import small_batches, staged, table, unused
from tickloom.llm.jaccard import near_duplicates, set_name
from tickloom.llm.quality_rules import verdict

ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return docs.where(verdict(F.col("text")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic; it is fitted on the labels of what came in."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.with_posteriors(docs, model).where(quality_classifier.kept()).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, and of its texts that of the first set.

    Decisions hold for an id and a set of shingles, so that another text of a repeated id stays. A row without id goes
    if one with an id has its set. Of repeated rows one stays, of texts without words each.
    """
    found = near_duplicates(docs, words=5, percent=80).where("set_key is not null").select("doc_id", "component_id", "set_key").distinct()
    found = staged(found, "components")
    heads = found.where("doc_id = component_id").select("doc_id", "set_key")
    first = heads.groupBy("doc_id").agg(F.min("set_key").alias("first"))
    later = heads.join(first, "doc_id").where("set_key > first").select("doc_id", "set_key")
    gone = found.where("component_id is not null and (doc_id is null or doc_id != component_id)").select("doc_id", "set_key").unionByName(later)
    gone_id, gone_key, gone_known, key, number, known, digest = (unused(n, docs) for n in ("gone_id", "gone_key", "gone_known", "key", "number", "known", "digest"))
    of_id = lambda a, b: {a: F.coalesce("doc_id", F.lit(0)), b: F.col("doc_id").isNotNull()}
    gone = gone.withColumns(of_id(gone_id, gone_known)).select(gone_id, gone_known, F.col("set_key").alias(gone_key))
    named = docs.withColumns({key: set_name(F.col("text"), 5), digest: F.md5("text"), **of_id(number, known)})
    left = named.join(gone, (F.col(key) == F.col(gone_key)) & (F.col(number) == F.col(gone_id)) & (F.col(known) == F.col(gone_known)), "left_anti")
    # a text fixes its set, so rows of one id and text lie together since the join, and texts are dealt only once
    return left.dropDuplicates([key, number, known, digest]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; a document of which nothing is left goes."""
    kept = suffix_dedup.without_repeats(docs, 400).where(F.length(F.trim("text")) > 0)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near copies", near_copies), ("repeats", repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
