"""Explanation prompts for the best matches: a table ready for any language-model client.

A prompt states what the match found (rank, scores, mandatory skills met, missing or short of years, free capacity)
beside the two texts it was found from; what to ask about that is the caller's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import requirement_embedding_text
from ..operators.scoring import mandatory_keys

EXPLAIN_TOP = 10
_SKILLS = "array<struct<skill: string, category: string, min_experience_years: double>>"
#: What is asked when the caller asks nothing else.
QUESTIONS = ("Which of these findings decide the match, and what should be clarified before it is made?",)


def _findings() -> list[Column]:
    """Lines computed from a match, its requirement and its profile."""
    keys, years = mandatory_keys(F.col("mandatory_skills")), F.col("skill_years")
    absent = F.filter(F.array_distinct(keys), lambda k: ~F.map_contains_key(years, k))
    short = F.filter(F.col("mandatory_skills"), lambda x: (
        F.try_element_at(years, tx.skill_key(tx.blank_if_null(x["skill"]))) < x["min_experience_years"]))

    def listed(items: Column) -> Column:
        return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit("none"))

    years_of = F.transform(F.coalesce(short, F.array().cast(_SKILLS)), lambda x: F.concat(
        tx.strip(x["skill"]), F.lit(" ("),
        tx.number_text(F.try_element_at(years, tx.skill_key(tx.blank_if_null(x["skill"])))), F.lit(" of "),
        tx.number_text(x["min_experience_years"]), F.lit(")")))
    return [
        F.format_string("- Place %d of %d, score %.4f (%s)", "rank", "total_matches", "final_rank", "confidence"),
        F.format_string("- Mandatory skills: %d wanted, %d absent", F.size(F.array_distinct(keys)), F.size(absent)),
        F.concat(F.lit("- Absent: "), listed(absent)),
        F.concat(F.lit("- Short of years: "), listed(years_of)),
        F.concat(F.lit("- Free capacity: "), tx.number_text(F.col("current_bandwidth_percent")), F.lit(" percent")),
    ]


def explanation_prompts(matches: DataFrame, profiles: DataFrame, requirements: DataFrame,
                        explain_top: int = EXPLAIN_TOP, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """``requirement_id, employee_id, rank, prompt`` for the first ``explain_top`` matches; 0 gives none."""
    if explain_top < 0:
        raise ValueError(f"explain_top must not be negative, got {explain_top}")
    best = matches.where(F.col("rank") <= explain_top).select(
        "requirement_id", "employee_id", "rank", "total_matches", "final_rank", "confidence", "current_bandwidth_percent")
    wanted = requirements.select("requirement_id", "mandatory_skills", requirement_embedding_text().alias("requirement_text"))
    people = profiles.select("employee_id", "profile_text", "skill_years")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Wanted:\n"), F.col("requirement_text")),
        F.concat(F.lit("Offered:\n"), F.col("profile_text")),
        F.concat_ws("\n", F.lit("Findings:"), *_findings()),
        *[F.lit(q) for q in questions],
    )
    return (
        best.join(wanted, "requirement_id").join(people, "employee_id")
        .select("requirement_id", "employee_id", "rank", prompt.alias("prompt"))
    )


def attach_explanations(matches: DataFrame, explanations: DataFrame) -> DataFrame:
    """Left join of stored answers (``requirement_id, employee_id, explanation``) to the matches."""
    answers = explanations.select("requirement_id", "employee_id", "explanation")
    return matches.join(answers, ["requirement_id", "employee_id"], "left")
