import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from staffmatch.functions import numeric as nm
from staffmatch.operators.profiles import build_profiles
from staffmatch.operators.scoring import score_pairs
from staffmatch.plans.match import match, rank_pairs
from staffmatch.sources.requirements import split_by_weights
from tests.helpers import employee_rows, employees, requirement, requirements


def scored(spark, emp, reqs, similarity=0.9, **kw):
    profiles = build_profiles(employees(spark, *emp))
    wanted = requirements(spark, *reqs)
    pairs = spark.createDataFrame(
        [(r[0], e[0][0], similarity) for r in reqs for e in emp],
        "requirement_id string, employee_id string, similarity double")
    out = rank_pairs(score_pairs(pairs, profiles, wanted, **kw))
    return {(r["requirement_id"], r["employee_id"]): r for r in out.collect()}


BASE = employee_rows("E1", [("Python", "P", 6.0), ("SQL", "D", 5.0)])


def test_worked_example(spark):
    r = scored(spark, [BASE], [requirement(mandatory=[("Python", "", None), ("AWS", "", None)], years=5.0)])[("R1", "E1")]
    assert (r["skill_coverage"], r["skill_experience_score"], r["domain_score"], r["experience_score"]) == (0.5, 0.5, 1, 1)
    assert r["technical_score"] == pytest.approx(0.65) and r["availability"] == 0.8
    assert (r["rule_score"], r["calibrated_rule_score"], r["final_rank"], r["confidence"]) == (52.0, 0.52, 0.748, "Medium")


def test_empty_and_repeated_mandatory_lists(spark):
    got = scored(spark, [BASE], [
        requirement("none"),
        requirement("twice", [(" PYTHON", "", None), ("python", "", None), ("AWS", "", None)]),
    ])
    assert got[("none", "E1")]["skill_coverage"] == 1.0 and got[("none", "E1")]["skill_experience_score"] == 0.0
    assert got[("none", "E1")]["technical_score"] == pytest.approx(0.7)
    twice = got[("twice", "E1")]
    assert twice["skill_coverage"] == pytest.approx(1 / 3) and twice["skill_experience_score"] == pytest.approx(2 / 3)


def test_skill_years_only_when_asked_for(spark):
    reqs = [requirement("R1", [("Python", "", 12.0), ("SQL", "", 0.0), ("AWS", "", 1.0)])]
    assert scored(spark, [BASE], reqs)[("R1", "E1")]["skill_experience_score"] == pytest.approx(2 / 3)
    by_years = scored(spark, [BASE], reqs, use_skill_years=True)[("R1", "E1")]
    assert by_years["skill_experience_score"] == pytest.approx((0.5 + 1 + 0) / 3)
    repeated = [requirement("R1", [("Python", "", 6.0), ("python", "", 24.0)])]
    last = scored(spark, [BASE], repeated, use_skill_years=True)[("R1", "E1")]
    assert last["skill_experience_score"] == pytest.approx(0.25)


def test_bandwidth_domain_and_partial_weights(spark):
    people = [employee_rows(f"B{b:.0f}", [("Python", "", 1.0)], bandwidth=b, domain_years=2.0, total_years=5.0)
              for b in (0.0, 100.0, 140.0)]
    got = scored(spark, people, [requirement("R1", [("Python", "", None)], years=4.0), requirement("R0", years=0.0)],
                 weights={"domain": 1.0})
    assert [got[("R1", e)]["availability"] for e in ("B0", "B100", "B140")] == [0.5, 1.0, 1.2]
    assert got[("R1", "B0")]["domain_score"] == 0.5 and got[("R0", "B0")]["domain_score"] == 1.0
    assert got[("R1", "B100")]["technical_score"] == pytest.approx(0.4 + 0.3 + 0.5 + 0.05)


def test_confidence_bounds_and_ties(spark):
    frame = spark.createDataFrame([(0.82,), (0.8199,), (0.65,), (0.6499,)], "x double")
    assert [r[0] for r in frame.select(nm.confidence(F.col("x"))).collect()] == ["High", "Medium", "Medium", "Low"]
    twins = [employee_rows(e, [("Python", "", 1.0)]) for e in ("E2", "E1", "E3")]
    got = scored(spark, twins, [requirement("R1")])
    assert [got[("R1", e)]["rank"] for e in ("E1", "E2", "E3")] == [1, 2, 3]


def test_argument_checks(spark):
    for bad in ({"mandatory": 1.1}, {"domain": -0.1}, {"other": 0.1}):
        with pytest.raises(ValueError):
            nm.resolve_weights(bad)
    for n in (0, -1):
        with pytest.raises(ValueError):
            match(None, None, None, top_n=n)
    from staffmatch.plans.explain import explanation_prompts

    with pytest.raises(ValueError):
        explanation_prompts(None, None, None, explain_top=-1)


def test_rows_with_weights_out_of_range_are_set_aside(spark):
    frame = spark.createDataFrame(
        [("a", (0.1, None, 0.2, 1.0)), ("b", (1.2, 0.1, 0.1, 0.1)), ("c", None)],
        "requirement_id string, weights struct<mandatory:double,skill_exp:double,domain:double,experience:double>")
    ok, bad = split_by_weights(frame)
    assert [r[0] for r in ok.orderBy("requirement_id").collect()] == ["a", "c"]
    assert [r["requirement_id"] for r in bad.collect()] == ["b"]


@settings(max_examples=15, deadline=None)
@given(hs.lists(hs.tuples(hs.floats(0, 40), hs.floats(0, 40), hs.floats(0, 100), hs.floats(0, 20)), min_size=1, max_size=8))
def test_scores_stay_in_bounds(spark, values):
    frame = spark.createDataFrame(values, "domain double, total double, bandwidth double, need double")
    weights = nm.resolve_weights()
    technical = nm.technical_score(F.lit(0.5), F.lit(0.25), nm.domain_score(F.col("domain"), F.col("need")),
                                   nm.experience_score(F.col("total")), weights)
    available = nm.availability(F.col("bandwidth"))
    for r in frame.select(nm.rule_score(technical, available).alias("s"),
                          nm.calibrated_rule_score(technical, available).alias("c")).collect():
        assert 0 <= r["s"] <= 100 and 0 <= r["c"] <= 1 and math.isclose(r["s"] / 100, r["c"], abs_tol=0.006)
