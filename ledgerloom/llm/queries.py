"""Registered queries of the operators, each over its whole table with the operator's own parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import oracle
from ledgerloom.llm.collocations import collocations
from ledgerloom.llm.decontamination import passages
from ledgerloom.llm.fingerprints import fingerprint_next
from ledgerloom.llm.frames import table
from ledgerloom.llm.html_text import extract
from ledgerloom.llm.jaccard_join import classes
from ledgerloom.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, scan
from ledgerloom.llm.packing import pack, word_count
from ledgerloom.llm.pii import find, summary
from ledgerloom.llm.prefix_trie import prefix_trie
from ledgerloom.llm.substrings import without_repeats
from ledgerloom.llm.token_output import token_output
from ledgerloom.llm.toxicity import toxicity
from ledgerloom.llm.url_lists import judge, page_captures, page_lists, validity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(page_captures(pages), validity(page_lists(pages)))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_next(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "matched", "width")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, word_count(F.col("text")), tie=F.xxhash64("text"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_license_scans": op7_license_scans,
    "op8_token_id_output": op8_token_id_output,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_packing": op10_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrase_collocation_mining": op13_phrase_collocation_mining,
}
#: The others can't be written in SQL; tests compare them with brute force.
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": oracle.NGRAM_JACCARD,
    "op5_url_filters": oracle.URL_LISTS,
    "op7_license_scans": oracle.licenses(PHRASES, TEMPLATES, CONTAINMENT),
    "op11_conversation_prefix_trie": oracle.PREFIX_TRIE,
    "op12_substring_dedup": oracle.SUBSTRINGS,
    "op13_phrase_collocation_mining": oracle.COLLOCATIONS,
}
