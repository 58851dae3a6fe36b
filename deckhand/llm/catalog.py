"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deckhand.llm import extraction, lexical, licences, media, neardup, oracles, packing, periods, pii, quality, records, suffixes, tokencounts, wordbpe

ORACLES: dict[str, str] = {
    "op6_bucketed_suffixes": oracles.REPEATS, "op9_multi_index_hamming": oracles.NEAR, "op11_lag_planes": oracles.RUNS, "op13_threshold_search": oracles.RANKED, "base_media": oracles.MEDIA, "base_licences": oracles.LICENCES, "base_quality": oracles.QUALITY,
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op2_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def op3_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digest(documents(spark, sf_dir))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data, whole conversations, of which only the assistant's turns bear loss."""
    return packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_bucketed_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(documents(spark, sf_dir))


def op7_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.bpe_digest(documents(spark, sf_dir))


def op9_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digest(documents(spark, sf_dir))


def op11_lag_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(documents(spark, sf_dir))


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_digest(documents(spark, sf_dir))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def base_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2's result: the payloads that were read back."""
    return op2_media_archive(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3's result: words and base phrases."""
    return op3_signature_rules(spark, sf_dir).drop("labels", "score")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7's result: the counts of the plain rules."""
    return op7_line_labelling(spark, sf_dir).drop("kept", "content_share")


QUERIES = {f.__name__: f for f in (op1_feistel_pseudonyms, op2_media_archive, op3_signature_rules, op4_vector_packing, op5_dom_sum_product, op6_bucketed_suffixes, op7_line_labelling, op8_word_bpe, op9_multi_index_hamming, op10_token_records, op11_lag_planes, op12_whole_token_counts, op13_threshold_search, packed_conversations, base_media, base_licences, base_quality)}
