"""The queries of the training-data operators: each over its whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lendmill.llm import divergence, lexical, mixing, url_filter
from lendmill.llm.fingerprints import fingerprint_documents
from lendmill.llm.html_text import extract_pages
from lendmill.llm.jaccard_join import jaccard_components
from lendmill.llm.language_id import fit_language_id, identify
from lendmill.llm.media import media_digests
from lendmill.llm.packing import pack
from lendmill.llm.secrets import secret_report
from lendmill.llm.tasks import table
from lendmill.llm.token_counts import count_tokens
from lendmill.llm.toxicity import fit_toxicity, score_toxicity


def byte_vocabulary() -> dict:
    """Files, pattern and special string of the byte-level vocabulary of byte_bpe_50k.json."""
    return {"file": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": (("<|endoftext|>", 50256),)}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), **byte_vocabulary(), window=1024, end_id=0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.ENTRIES, url_filter.ENTRY_SCHEMA))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_report(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language_id(docs))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_ranked_search": op13_ranked_search,
}
LLM_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.SQL,
    "op4_mixing": mixing.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_ranked_search": lexical.SQL,
}
