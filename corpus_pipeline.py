"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmatch.llm import debruijn, langid_nb, packing, simhash_bk, toxicity_gru
from staffmatch.llm.scratch import Scratch

#: A document stays if one language has at least this posterior, that is, more than all others together.
LEAST_LANGUAGE_SCORE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """The text beside a struct of all other columns, so that no column of a scorer replaces one of the documents'."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _restored(scored: DataFrame, docs: DataFrame) -> DataFrame:
    return scored.select("row.*", "text").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go. Texts without words score 0 and stay."""
    net = toxicity_gru.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(toxicity_gru.score(_carried(docs), net).where("predicted = 0"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language has the majority of the posterior, go."""
    found = langid_nb.identify(_carried(docs), langid_nb.fit(docs))
    return _restored(found.where((F.col("lang_pred") != langid_nb.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Of repeated rows with one id and text one stays, the one with the smallest hash of its other columns; different texts
    under the id that stays all stay. Rows without an id cannot be named as the one that stays, nor be left out for
    another: all of them stay. A null text is a text of its own.
    """
    groups = simhash_bk.near_duplicates(docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*others) if others else F.lit(None)
    place = F.xxhash64(*[c.cast("string") for c in others]) if others else F.lit(0)
    named = (docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").groupBy("doc_id", "text")
             .agg(F.min_by(row, place).alias("row")))
    kept = named.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier document go, and `n_chars` follows; a document may be left without words."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    cut = debruijn.remove_repeats(docs.select("doc_id", "text", row.alias("row")))

    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias(name)
        return F.col(f"row.`{name}`")

    return cut.select(*[column(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences by their words; a document without words has no piece. Rows with null or
    repeated ids are packed one by one, an empty table gives no rows, other columns are ignored."""
    return packing.pack(Scratch(spark, "packing").store(packing.word_lengths(docs), "lengths"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("sequences", sequences)]

#: None of these stages can be said in SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of `documents`: every stage's result is written below the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = scratch.store(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
