"""Registered corpus queries with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm import decontaminate, licenses, linededup, lmscore, mixing, quality, simhash, tokenalign, topk, toxicity, tries, urls, warc
from dyadic.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derived records of every page; the headers are a map from field to value."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    fields = F.map_from_entries("headers")
    return made.select(
        F.col("page_id").cast("long").alias("page_id"), "record_id", "type", "uri", "date", "refers_to",
        fields["WARC-Block-Digest"].alias("block_digest"), fields["Content-Type"].alias("content_type"),
        fields["Content-Length"].cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("content"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("group")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_texts(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.alignment(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_top_k": op4_top_k,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_lm_scores": op11_lm_scores,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op4_top_k": topk.OP4_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_url_verdicts": urls.OP10_SQL,
    "op12_prefix_trie": tries.OP12_SQL,
}
