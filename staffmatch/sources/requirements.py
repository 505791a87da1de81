"""Requirement sources: text files and stored JSON replies, with error quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schemas import REQUIREMENT_BODY

# Fixed error classes.
NOT_JSON = "JSON parsing failed"
WRONG_SHAPE = "Extraction failed"

_CORRUPT = "_corrupt_record"


def read_requirement_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 ``.txt`` file: ``source_file, requirement_text``; other suffixes are skipped."""
    return (
        spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("requirement_text"))
    )


def strip_fences(raw: F.Column) -> F.Column:
    return tx.strip(F.regexp_replace(raw, "```json|```", ""))


def _once(rows: DataFrame, *columns: F.Column) -> DataFrame:
    """Adds columns through a one-row generator. Filters and projections on them are not merged into the
    expressions, so an expensive parse runs once per row however often its result is used."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _classified(replies: DataFrame) -> DataFrame:
    schema = T.StructType(REQUIREMENT_BODY.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    cleaned = _once(replies, strip_fences(tx.blank_if_null(F.col("raw"))).alias("raw_output"))
    parsed = _once(
        cleaned,
        F.try_parse_json("raw_output").alias("_variant"),
        F.from_json("raw_output", schema, options).alias("_body"),
    )
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_variant"), F.lit("OBJECT")), F.lit(False))
    return parsed.withColumn(
        "error",
        F.when(F.col("_variant").isNull(), F.lit(NOT_JSON))
        .when(~is_object, F.lit(WRONG_SHAPE))
        .when(F.col("_body").isNull() | F.col(f"_body.{_CORRUPT}").isNotNull(), F.lit(WRONG_SHAPE)),
    )


def parse_requirements(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ok, quarantine)`` from a table with a ``raw`` column; other columns are carried along.

    Extra JSON keys are ignored, missing keys are null. The quarantine keeps the cleaned reply.
    """
    parsed = _classified(replies)
    carried = [c for c in replies.columns if c != "raw"]
    ok = parsed.where("error IS NULL").select(
        *carried, *[F.col(f"_body.{f.name}").alias(f.name) for f in REQUIREMENT_BODY.fields]
    )
    details = F.when(
        F.col("error") == NOT_JSON, F.lit("the reply is not valid JSON")
    ).otherwise(F.lit("the reply does not fit the requirement schema"))
    bad = parsed.where("error IS NOT NULL").select(*carried, "error", details.alias("details"), "raw_output")
    return ok, bad


def split_by_weights(requirements: DataFrame, column: str = "weights") -> tuple[DataFrame, DataFrame]:
    """``(ok, quarantine)`` by the range check of per-row weights."""
    from ..functions.numeric import weights_in_range

    ok = weights_in_range(column)
    reason = F.lit("weights must lie in [0, 1]")
    return requirements.where(ok), requirements.where(~ok).withColumn("error", reason)
