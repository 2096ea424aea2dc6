"""The corpus queries: thin digests over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, centroid_clustering, chat, hard_negatives, html_extraction, language_id, oracles, packing, quality_classifier, suffix_dedup
from tickloom.llm.ann import nearest
from tickloom.llm.common import table
from tickloom.llm.jaccard import near_duplicates
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.token_counts import token_counts


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded over the distinct-word table and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of quality and toxicity of every document, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_posteriors(docs, model, carry=["doc_id"])
    return scored.select("doc_id", "p_quality", "p_toxic", quality_classifier.kept().alias("kept"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return pages.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that start anywhere else, as counts and a digest."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.crc32(packing.pack(table(spark, sf_dir, "documents"), path))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).drop("set_key")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back, as counts and digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digest(chat.render(chat.reconstruct(chat.conversation_events(rows.unionByName(hard)))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the repetition-coverage verdict of every document."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("dup_line_share", "dup_gram_share", "top_gram_share")})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of other labels for each of the five nearest of its own label, for every fiftieth embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("id") % 50 == 0)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = language_id.identify(docs, learn=quarter != 2, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters, after ten rounds."""
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_bpe,
            op2_quality_classifier,
            op3_html_extraction,
            op4_token_counts,
            op5_suffix_dedup,
            op6_packing,
            op7_jaccard_join,
            op8_ann,
            op9_chat,
            op10_quality_rules,
            op11_hard_negatives,
            op12_language_id,
            op13_centroid_clustering,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express; the others are tested against brute-force versions."""
    return oracles.oracle_sql()
