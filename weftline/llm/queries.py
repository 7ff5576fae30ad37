"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import ann, chat, collocations, lm_trie, media, mixing, packing, quality, secret_scan, simhash, toxicity, url_filter, variants
from weftline.llm.oracles import ORACLES
from weftline.sources.tables import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the trigram trie, beside a smoothed unigram base."""
    return lm_trie.lm_digest(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the list entries in force when each page was fetched."""
    return url_filter.filtered_pages(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans, and weak parts that complete each other."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated towards the target weights of their sources, in one global order."""
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.temperature_rates(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by subword bags, learnt outside fold 0."""
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth vector, among all others."""
    return ann.nearest_digest(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by hashed n-grams, learnt outside fold 0."""
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a picture, read back, with features."""
    return media.media_digest(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, and digests of what is read back from them."""
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words and the form that each is a variant of."""
    return variants.variant_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
