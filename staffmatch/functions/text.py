"""Text helpers and the text layouts shared by employees and requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, at either end.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(value: Column) -> Column:
    """Drop Unicode white space at both ends (Spark's ``trim`` drops only U+0020)."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def skill_key(value: Column) -> Column:
    return F.lower(strip(value))


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def number_text(value: Column) -> Column:
    """8.0 prints as ``8``, 8.5 as ``8.5``; null stays null."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, F.when(whole, value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def number_or_na(value: Column) -> Column:
    return F.coalesce(number_text(value), F.lit("N/A"))


def joined_or_na(values: Column) -> Column:
    """Array of strings as ``a, b``; ``N/A`` when null or empty."""
    return F.coalesce(F.nullif(F.array_join(values, ", "), F.lit("")), F.lit("N/A"))


# ---- fixed layouts (the texts must match these line formats) -------------------------------

def skill_line(skill: Column, category: Column, years: Column) -> Column:
    return F.concat(
        F.lit("- Skill: "), skill, F.lit(" | Category: "), category,
        F.lit(" | Experience: "), number_text(years), F.lit(" years"),
    )


def profile_layout(domain: Column, domain_years: Column, total_years: Column, summary: Column, skills: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("Employee Profile"),
        F.concat(F.lit("Primary Domain: "), domain),
        F.concat(F.lit("Domain Experience: "), number_text(domain_years), F.lit(" years")),
        F.concat(F.lit("Total Experience: "), number_text(total_years), F.lit(" years")),
        F.concat(F.lit("Past Project Summary: "), summary),
        F.lit("Skills:"),
        skills,
    )


def requirement_embedding_text() -> Column:
    """Text of a requirement row in the employee layout, so that both sides encode alike."""
    def name(x):
        return strip(blank_if_null(x["skill"]))

    def category(x):
        stripped = strip(blank_if_null(x["category"]))
        return F.when(stripped == "", F.lit("General")).otherwise(stripped)

    def mandatory(x):
        plain = F.concat(F.lit("- Skill: "), name(x), F.lit(" | Category: "), category(x))
        years = x["min_experience_years"]
        return F.when(years != 0, skill_line(name(x), category(x), years)).otherwise(plain)

    def optional(x):
        return F.concat(F.lit("- Skill: "), name(x), F.lit(" | Category: "), category(x), F.lit(" | Optional"))

    lines = F.concat(
        F.coalesce(F.transform("mandatory_skills", mandatory), F.array().cast("array<string>")),
        F.coalesce(F.transform("optional_skills", optional), F.array().cast("array<string>")),
    )
    skills = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("None"))
    years = F.coalesce(F.col("minimum_overall_experience_years"), F.lit(0.0))
    description = F.coalesce(F.col("project_description"), F.lit("N/A"))
    return profile_layout(joined_or_na(F.col("domain")), years, years, description, skills)


def requirement_display_text() -> Column:
    """Text of a requirement row for people to read."""
    def one(x):
        skill, category, years = blank_if_null(x["skill"]), blank_if_null(x["category"]), x["min_experience_years"]
        with_category = F.when(category != "", F.concat(F.lit(", "), category)).otherwise(F.lit(""))
        return (
            F.when(years != 0, F.concat(skill, F.lit(" ("), number_text(years), F.lit(" years"), with_category, F.lit(")")))
            .when(category != "", F.concat(skill, F.lit(" ("), category, F.lit(")")))
            .otherwise(skill)
        )

    def skills(column):
        return F.when(F.size(column) > 0, F.array_join(F.transform(column, one), ", ")).otherwise(F.lit("None"))

    text = F.concat(
        F.lit("Project Description:\n"), F.coalesce(F.col("project_description"), F.lit("N/A")),
        F.lit("\n\nDomain: "), joined_or_na(F.col("domain")),
        F.lit("\nCriticality: "), F.coalesce(F.col("project_criticality"), F.lit("N/A")),
        F.lit("\nDuration: "), number_or_na(F.col("project_duration_months")), F.lit(" months"),
        F.lit("\nRequired Bandwidth: "), number_or_na(F.col("required_bandwidth_percentage")), F.lit("%"),
        F.lit("\nMinimum Overall Experience: "), number_or_na(F.col("minimum_overall_experience_years")), F.lit(" years"),
        F.lit("\n\nMandatory Skills:\n"), skills("mandatory_skills"),
        F.lit("\n\nOptional Skills:\n"), skills("optional_skills"),
    )
    return strip(text)
