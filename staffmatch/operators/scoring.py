"""Rule scores of (requirement, employee) pairs.

Pairs are few per requirement (the candidate pool); requirement skills and employee skills come in as
small arrays and a map, so scoring is column arithmetic after two equi-joins and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx

REQUIREMENT_COLUMNS = ["mandatory_skills", "minimum_overall_experience_years"]


def mandatory_keys(mandatory: Column) -> Column:
    """Skill keys of the mandatory list, duplicates kept."""
    keys = F.transform(mandatory, lambda x: tx.skill_key(tx.blank_if_null(x["skill"])))
    return F.coalesce(keys, F.array().cast("array<string>"))


def coverage(skill_years: Column, keys: Column) -> Column:
    """Distinct matched keys over the length of the list; 1 for an empty list."""
    matched = F.size(F.filter(F.array_distinct(keys), lambda k: F.map_contains_key(skill_years, k)))
    n = F.size(keys)
    return F.when(n > 0, matched.cast("double") / F.when(n > 0, n)).otherwise(F.lit(1.0))


def _years_required(mandatory: Column, key: Column) -> Column:
    """Required years of a key; the last entry of a repeated skill counts."""
    same = F.filter(mandatory, lambda x: tx.skill_key(tx.blank_if_null(x["skill"])) == key)
    return F.try_element_at(same, F.lit(-1))["min_experience_years"]


def skill_experience(skill_years: Column, keys: Column, mandatory: Column, use_skill_years: bool = False) -> Column:
    """Mean over the list of per-skill ratios; 0 for an empty list."""
    def ratio(key):
        have = F.try_element_at(skill_years, key)
        full = nm.capped_ratio(have, _years_required(mandatory, key)) if use_skill_years else F.lit(1.0)
        return F.when(F.map_contains_key(skill_years, key), full).otherwise(F.lit(0.0))

    n = F.size(keys)
    total = F.aggregate(F.transform(keys, ratio), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / F.when(n > 0, n)).otherwise(F.lit(0.0))


def score_columns(weights: dict[str, Column], use_skill_years: bool = False) -> dict[str, Column]:
    """Every score part over ``skill_years``, the header fields and the requirement columns."""
    keys, mandatory, years = F.col("mandatory_keys"), F.col("mandatory_skills"), F.col("skill_years")
    return {
        "skill_coverage": coverage(years, keys),
        "skill_experience_score": skill_experience(years, keys, mandatory, use_skill_years),
        "domain_score": nm.domain_score(F.col("domain_experience_years"), F.col("minimum_overall_experience_years")),
        "experience_score": nm.experience_score(F.col("total_experience_years")),
        "technical_score": nm.technical_score(
            F.col("skill_coverage"), F.col("skill_experience_score"), F.col("domain_score"),
            F.col("experience_score"), weights,
        ),
        "availability": nm.availability(F.col("current_bandwidth_percent")),
        "rule_score": nm.rule_score(F.col("technical_score"), F.col("availability")),
        "calibrated_rule_score": nm.calibrated_rule_score(F.col("technical_score"), F.col("availability")),
    }


def score_pairs(
    pairs: DataFrame,
    profiles: DataFrame,
    requirements: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    weights_column: str | None = None,
    use_skill_years: bool = False,
) -> DataFrame:
    """``pairs`` (requirement_id, employee_id, ...) joined to both sides, with every score part added.

    Pairs whose employee has no profile drop out. The domain name is not compared and the requirement's
    overall minimum years serve as its domain years.
    """
    needed = ["requirement_id", *REQUIREMENT_COLUMNS] + ([weights_column] if weights_column else [])
    wanted = requirements.select(*needed).withColumn("mandatory_keys", mandatory_keys(F.col("mandatory_skills")))
    scored = pairs.join(wanted, "requirement_id").join(profiles, "employee_id")
    parts = score_columns(nm.resolve_weights(weights, weights_column), use_skill_years)
    for name in ("skill_coverage", "skill_experience_score", "domain_score", "experience_score", "availability"):
        scored = scored.withColumn(name, parts[name])
    scored = scored.withColumn("technical_score", parts["technical_score"])
    return scored.withColumns({n: parts[n] for n in ("rule_score", "calibrated_rule_score")})
