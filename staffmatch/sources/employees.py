"""Employee CSV ingest: columns by name, typed values, quarantine for rows that cannot be scored."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import EMPLOYEE_SKILL

REQUIRED_NUMBERS = ["domain_experience_years", "total_experience_years", "skill_experience_years"]
TEXTS = ["employee_name", "domain", "past_project_execution_summary", "skill", "skill_category"]
# Headers written by data-frame exports for nameless columns; Spark itself names blank headers ``_cN``.
_NAMELESS = re.compile(r"^(Unnamed|_c\d+$)")


def read_employee_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as strings, nameless columns dropped. Accepts a ``.csv`` file or a directory of them.

    With ``multi_line`` values may hold line breaks, but Spark cannot split a file then; for very large
    files without line breaks inside values, turn it off. Files without a ``row_seq`` column get one by file name
    and place in the file, however they are split.
    """
    leaf = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in leaf and not leaf.lower().endswith(".csv"):
        raise ValueError(f"employee files must be .csv, got {path!r}")
    rows = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("pathGlobFilter", "*.[cC][sS][vV]").csv(path)
    )
    named = [F.col(f"`{c}`") for c in rows.columns if not _NAMELESS.match(c)]
    return rows.select(*named) if "row_seq" in rows.columns else _numbered(rows, named)


def _numbered(rows: DataFrame, named: list) -> DataFrame:
    """The rows with ``row_seq``: rows counted per file and split, prefix sums over the splits, and the place in a split.

    A task reads its splits one after the other, so a split's rows have consecutive running numbers there. The counts
    (a row per split) are the only thing that is ordered as a whole.
    """
    placed = rows.select(
        *named, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"))
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    order = W.orderBy(F.element_at(F.split("_file", "/"), -1), "_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_rows").over(order), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(offsets, ["_file", "_start"]).withColumn(
        "row_seq", F.col("_place") + F.col("_shift") + 1).drop("_file", "_start", "_place", "_shift")


def typed_employees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantine)``: casts by column name, blank texts for nulls, a reason per rejected row.

    ``row_seq`` is taken from the source; without one the scan order of a single file is used.
    """
    if "employee_id" not in rows.columns:
        raise ValueError("employee table has no employee_id column")

    def text(name):
        if name not in rows.columns:
            return F.lit("N/A" if name == "past_project_execution_summary" else "")
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def number(name):
        return F.col(name).try_cast("double") if name in rows.columns else F.lit(None).cast("double")

    row_seq = F.col("row_seq").try_cast("bigint") if "row_seq" in rows.columns else F.monotonically_increasing_id() + 1
    employee_id = F.col("employee_id").cast("string")
    bandwidth = number("current_bandwidth_percent") if "current_bandwidth_percent" in rows.columns else F.lit(100.0)
    typed = rows.select(
        employee_id.alias("employee_id"), row_seq.cast("bigint").alias("row_seq"),
        *[text(c).alias(c) for c in TEXTS],
        *[number(c).alias(c) for c in REQUIRED_NUMBERS],
        bandwidth.alias("current_bandwidth_percent"),
    )
    checks = [(F.coalesce(F.col("employee_id"), F.lit("")) == "", "employee_id is empty"),
              (F.col("row_seq").isNull(), "row_seq is not an integer")]
    for c in [*REQUIRED_NUMBERS, "current_bandwidth_percent"]:
        checks.append((F.col(c).isNull() | F.isnan(c), f"{c} is not a number"))
    reason = F.concat_ws("; ", *[F.when(bad, F.lit(why)) for bad, why in checks])
    checked = typed.withColumn("reason", reason)
    names = EMPLOYEE_SKILL.fieldNames()
    clean = checked.where("reason = ''").select(*names)
    return clean, checked.where("reason <> ''").select(*names, "reason")


def load_employees(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV to ``(clean, quarantine)``."""
    return typed_employees(read_employee_csv(spark, path, multi_line))


def save_snapshot(store, clean: DataFrame) -> dict[str, int]:
    """Publish the cleaned rows as the new employee snapshot; the row count is taken during the write."""
    from pyspark.sql import Observation

    seen = Observation("snapshot")
    version = store.current("employees") + 1
    store.stage("employees", version, clean.observe(seen, F.count("*").alias("rows_loaded")))
    store.publish("employees", version)
    return {"version": version, "rows_loaded": seen.get["rows_loaded"]}


def read_snapshot(store) -> DataFrame:
    rows = store.read("employees", EMPLOYEE_SKILL)
    if rows is None:
        raise FileNotFoundError("no employee snapshot yet: load employees first")
    return rows
