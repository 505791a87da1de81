"""Scalar scoring arithmetic. Everything here is a plain Column expression (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
DEFAULT_WEIGHTS = {"mandatory": 0.4, "skill_exp": 0.3, "domain": 0.2, "experience": 0.1}
FULL_EXPERIENCE_YEARS = 10.0
SIMILARITY_SHARE = 0.6
RULE_SHARE = 0.4
HIGH_CONFIDENCE = 0.82
MEDIUM_CONFIDENCE = 0.65
DEFAULT_BANDWIDTH = 100.0


def round_half_up(value: Column, digits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``: the same bits in any SQL engine, unlike the various ``round``s."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def capped_ratio(have: Column, need: Column) -> Column:
    """``min(have / need, 1)``; 1 when nothing (null, zero or less) is needed."""
    return F.when(need > 0, F.least(have / F.when(need > 0, need), F.lit(1.0))).otherwise(F.lit(1.0))


def domain_score(domain_years: Column, required_years: Column) -> Column:
    return capped_ratio(domain_years, F.coalesce(required_years, F.lit(0.0)))


def experience_score(total_years: Column) -> Column:
    return F.least(total_years / F.lit(FULL_EXPERIENCE_YEARS), F.lit(1.0))


def availability(bandwidth_percent: Column) -> Column:
    """Not clamped: a bandwidth above 100 raises the factor above 1."""
    return F.lit(0.5) + F.coalesce(bandwidth_percent, F.lit(DEFAULT_BANDWIDTH)) / F.lit(200.0)


def technical_score(
    coverage: Column, skill_experience: Column, domain: Column, experience: Column, weights: dict[str, Column]
) -> Column:
    """Weighted sum of the four parts; the weights are used as given, not re-normalised."""
    return (
        weights["mandatory"] * coverage
        + weights["skill_exp"] * skill_experience
        + weights["domain"] * domain
        + weights["experience"] * experience
    )


def rule_score(technical: Column, available: Column) -> Column:
    """0..100 score, two decimals."""
    return round_half_up(technical * available * F.lit(100.0), 2)


def calibrated_rule_score(technical: Column, available: Column) -> Column:
    """0..1 score, three decimals, taken from the unrounded 0..100 score."""
    return round_half_up(technical * available * F.lit(100.0) / F.lit(100.0), 3)


def final_rank(similarity: Column, calibrated: Column) -> Column:
    return round_half_up(F.lit(SIMILARITY_SHARE) * similarity + F.lit(RULE_SHARE) * calibrated, 4)


def confidence(rank_value: Column) -> Column:
    return (
        F.when(rank_value >= HIGH_CONFIDENCE, F.lit("High"))
        .when(rank_value >= MEDIUM_CONFIDENCE, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def resolve_weights(weights: dict[str, float] | None = None, column: str | None = None) -> dict[str, Column]:
    """Weight columns from a dict of literals or from a struct column; missing or null parts take the defaults."""
    if weights is not None and column is not None:
        raise ValueError("give weights either as a dict or as a column, not both")
    if column is not None:
        return {k: F.coalesce(F.col(column)[k], F.lit(v)) for k, v in DEFAULT_WEIGHTS.items()}
    check_weights(weights)
    given = weights or {}
    return {k: F.lit(float(given.get(k, v))) for k, v in DEFAULT_WEIGHTS.items()}


def check_weights(weights: dict[str, float] | None) -> None:
    for key, value in (weights or {}).items():
        if key not in DEFAULT_WEIGHTS:
            raise ValueError(f"unknown weight {key!r}; expected one of {sorted(DEFAULT_WEIGHTS)}")
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"weight {key!r} must lie in [0, 1], got {value}")


def weights_in_range(column: str) -> Column:
    """Predicate for per-row weight structs: every given part lies in [0, 1]."""
    ok = F.lit(True)
    for key in DEFAULT_WEIGHTS:
        ok = ok & F.coalesce(F.col(column)[key].between(0.0, 1.0), F.lit(True))
    return ok
