"""The registered queries of this subpackage: thin, whole-table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, bpe_count, main_text, mixing, multiset_hash, piece_automaton, postings, simhash, toxicity, winnow
from .common import table

#: Shares of expected tokens that the mixture aims at.
TARGETS = {"clean": 0.8, "low": 0.15, "toxic": 0.05}  # op1


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op2_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_id_files(table(spark, sf_dir, "documents"))


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "removed_lines", "removed_words")


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.document_fingerprints(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.page_texts(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_rows(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_automaton.piece_codes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_source_mixing, op2_bitplane_ids, op3_posting_lists, op4_token_counts, op5_line_winnowing, op6_simhash_bktree, op7_multiset_hash, op8_main_text, op9_toxicity, op10_piece_codes]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """None: no step here can be said in SQL to the byte (tokenizers, hashes, learned models); tests hold them against brute force."""
    return {}
