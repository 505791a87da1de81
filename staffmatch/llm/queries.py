"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from staffmatch.llm import (
    debruijn,
    divergence,
    embed_int8,
    grid_codes,
    langid_nb,
    packing,
    quality_adaptive,
    simhash_bk,
    spm_offsets,
    tokenfiles,
    toxicity_gru,
    url_rules,
    warc_dict,
)
from staffmatch.llm.sampling import held_out
from staffmatch.llm.scratch import Scratch
from staffmatch.llm.sql import SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = Scratch(spark, "packing").store(packing.word_lengths(_table(spark, sf_dir, "documents")), "lengths")
    return packing.pack(lengths)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid_nb.fit(docs)
    return langid_nb.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc_dict.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc_dict.read_archives(spark, path).drop("url", "payload")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read_documents(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity_gru.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity_gru.score(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_int8.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_adaptive.quality(_table(spark, sf_dir, "documents"), Scratch(spark, "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_offsets.document_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_packing, op3_langid, op4_warc, op5_substring, op6_tokens, op7_toxicity, op8_embeddings, op9_quality,
    op10_pieces, op11_divergence, op12_urls, op13_codes)} | {"pipeline": corpus_pipeline.run}
