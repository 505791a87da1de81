"""Employee profiles from employee-skill rows.

Order rules: the header comes from the first row, a skill's text line from its first row, its scoring
years from its last row, and the displayed list holds the raw values in first-seen order.

Shuffle plan: rows are first reduced per (employee, raw skill), with partial aggregation on the map
side, so an employee owning a large part of all rows is spread over its skills. Only distinct skills
are then moved by ``employee_id`` and collected; equal keys are resolved inside the small sorted array.
The header is a separate aggregate over its own columns, so wide summary texts never travel with skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

SUMMARY = "past_project_execution_summary"
HEADER_FIELDS = [
    "employee_name", "domain", "domain_experience_years", "total_experience_years",
    "current_bandwidth_percent", SUMMARY,
]


def employee_headers(employees: DataFrame, fields: list[str] = HEADER_FIELDS) -> DataFrame:
    """One row per employee, every field from the employee's first row.

    Header values repeat on all rows of an employee, so narrow headers are first reduced to the distinct
    ones: a hash aggregate with map-side reduction. With the long summary text, hashing costs more than
    the sort of a direct first-row aggregate (measured), which also reduces on the map side.
    """
    if SUMMARY not in fields:
        employees = employees.groupBy("employee_id", *fields).agg(F.min("row_seq").alias("row_seq"))
    return employees.groupBy("employee_id").agg(*[F.min_by(c, "row_seq").alias(c) for c in fields])


def distinct_raw_skills(employees: DataFrame) -> DataFrame:
    """One row per (employee, raw skill value) with what its first and last row say."""
    rows = employees.select(
        "employee_id", "row_seq", tx.blank_if_null(F.col("skill")).alias("skill"),
        "skill_category", "skill_experience_years",
    )
    return rows.groupBy("employee_id", "skill").agg(
        F.min("row_seq").alias("first_seq"),
        F.min_by("skill_category", "row_seq").alias("first_category"),
        F.min_by("skill_experience_years", "row_seq").alias("first_years"),
        F.max("row_seq").alias("last_seq"),
        F.max_by("skill_experience_years", "row_seq").alias("last_years"),
    )


def skill_years(employees: DataFrame) -> DataFrame:
    """Scoring view: one row per (employee, skill key), years from the last row; raw blanks are skipped."""
    rows = employees.where(tx.blank_if_null(F.col("skill")) != "")
    return rows.groupBy("employee_id", tx.skill_key(F.col("skill")).alias("skill_key")).agg(
        F.max_by("skill_experience_years", "row_seq").alias("years")
    )


def skill_first_lines(employees: DataFrame) -> DataFrame:
    """Text view: one row per (employee, skill key) with the first row's values; stripped blanks are skipped."""
    key = tx.skill_key(tx.blank_if_null(F.col("skill")))
    return (
        employees.withColumn("skill_key", key).where(F.col("skill_key") != "")
        .groupBy("employee_id", "skill_key")
        .agg(
            F.min("row_seq").alias("first_seq"),
            F.min_by(tx.strip(F.col("skill")), "row_seq").alias("skill"),
            F.min_by(tx.blank_if_null(F.col("skill_category")), "row_seq").alias("category"),
            F.min_by("skill_experience_years", "row_seq").alias("years"),
        )
    )


def build_profiles(employees: DataFrame, only: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """``employee_id``, header fields, ``skills`` list, ``skill_years`` map and ``profile_text``.

    ``with_text=False`` leaves the summary and the profile text out, so the summary is not even read;
    matching needs neither. ``only`` (``employee_id``) restricts the result; the semi joins sit above the first aggregates, so rows of a large employee are reduced before
    they meet on ``employee_id``, and the optimizer moves them below when the ids can be broadcast.
    """
    fields = HEADER_FIELDS if with_text else [c for c in HEADER_FIELDS if c != SUMMARY]
    raw, headers = distinct_raw_skills(employees), employee_headers(employees, fields)
    if only is not None:
        raw, headers = raw.join(only, "employee_id", "left_semi"), headers.join(only, "employee_id", "left_semi")
    key = tx.skill_key(F.col("skill"))
    line = F.struct(tx.strip(F.col("skill")).alias("skill"), tx.blank_if_null(F.col("first_category")).alias("category"),
                    F.col("first_years").alias("years"))
    # Separate lists, so that a query without texts drops the text part before the shuffles. Per key the
    # first row gives the text line and the last row the scoring years: the lists are sorted by
    # (key, order) and the first or last of each run of equal keys is kept.
    by_key = raw.groupBy("employee_id").agg(
        F.collect_list(F.struct("first_seq", "skill")).alias("listed"),
        F.collect_list(F.when(key != "", F.struct(key.alias("key"), F.col("first_seq").alias("at"), line.alias("line"))))
        .alias("first_of_key"),
        F.collect_list(F.when(F.col("skill") != "", F.struct(
            key.alias("key"), F.col("last_seq").alias("at"), F.col("last_years").alias("years")))).alias("last_of_key"),
    ).select("employee_id", *[F.array_sort(c).alias(c) for c in ("listed", "first_of_key", "last_of_key")])

    def run_starts(runs):
        return F.filter(runs, lambda x, i: ~x["key"].eqNullSafe(F.when(i > 0, F.get(F.col(runs), i - 1)["key"])))

    def run_ends(runs):
        return F.filter(runs, lambda x, i: ~x["key"].eqNullSafe(F.get(F.col(runs), i + 1)["key"]))

    lines = F.array_sort(F.transform(run_starts("first_of_key"), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    skills = by_key.select(
        "employee_id",
        F.transform("listed", lambda x: x["skill"]).alias("skills"),
        F.array_join(F.transform(lines, lambda x: tx.skill_line(
            x["line"]["skill"], x["line"]["category"], x["line"]["years"])), "\n").alias("skill_lines"),
        F.map_from_entries(F.transform(
            run_ends("last_of_key"), lambda x: F.struct(x["key"].alias("key"), x["years"].alias("years")))).alias("skill_years"),
    )
    joined = headers.join(skills, "employee_id")
    if not with_text:
        return joined.drop("skill_lines")
    blank = tx.blank_if_null
    return joined.select(
        "employee_id", *fields, "skills", "skill_years",
        tx.profile_layout(
            blank(F.col("domain")), F.col("domain_experience_years"), F.col("total_experience_years"),
            blank(F.col(SUMMARY)), F.col("skill_lines"),
        ).alias("profile_text"),
    )


# What the profile text is made of, and a prime below 2^31, so that products of two remainders fit 64 bits.
_TEXT_FIELDS = ["domain", "domain_experience_years", "total_experience_years", SUMMARY, "skill", "skill_category", "skill_experience_years"]
_PRIME = (1 << 31) - 1


def profile_fingerprints(employees: DataFrame) -> DataFrame:
    """``employee_id, fingerprint``: equal as long as an employee's rows and their relative places are.

    Sums of row hashes, alone and times the place, so rows are reduced on the map side in any order and no text is
    built. Moving all rows of an employee by the same number of places changes nothing. A different fingerprint does
    not mean a different text; that is for the caller to compare.
    """
    parts = [x for c in _TEXT_FIELDS for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_PRIME)) for seed in (1, 2)]
    place = F.pmod(F.col("row_seq"), F.lit(_PRIME))
    sums = employees.select("employee_id", "row_seq", place.alias("_place"), *[h.alias(f"_h{i}") for i, h in enumerate(hashes)]).groupBy("employee_id").agg(
        F.count("*").alias("n"), F.min("row_seq").alias("first_seq"),
        *[F.sum(f"_h{i}").alias(f"s{i}") for i in range(2)],
        *[F.sum(F.col(f"_h{i}") * F.col("_place") % _PRIME).alias(f"p{i}") for i in range(2)])
    base = F.pmod(F.col("first_seq"), F.lit(_PRIME))
    turned = [F.pmod(F.col(f"p{i}") % _PRIME - base * (F.col(f"s{i}") % _PRIME) % _PRIME, F.lit(_PRIME)) for i in range(2)]
    return sums.select("employee_id", F.concat_ws(":", "n", "s0", "s1", *turned).alias("fingerprint"))


def number_rows(rows: DataFrame, key: str, order: list[str], chunk: F.Column) -> DataFrame:
    """Dense 1-based ``row_seq`` per ``key`` in ``order``, without one task per key.

    ``chunk`` is a non-decreasing function of the first order column. Rows are numbered inside
    (key, chunk); the offsets come from the chunk counts, so a key with very many rows is shared
    out over its chunks.
    """
    chunked = rows.withColumn("_chunk", chunk)
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(key, "_chunk").count()
        .select(key, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy(key, "_chunk").orderBy(*order))
    numbered = chunked.withColumn("_pos", inside)
    return numbered.join(offsets, [key, "_chunk"]).withColumn(
        "row_seq", (F.col("_offset") + F.col("_pos")).cast("bigint")
    ).drop("_chunk", "_offset", "_pos")
