from pyspark.sql import functions as F

from staffmatch.functions import text as tx
from staffmatch.operators.profiles import build_profiles
from tests.helpers import employee_rows, employees, requirement, requirements


def test_profile_text_layout(spark):
    rows = employee_rows("E1", [("Rigging", "Deck work", 6.0), ("Radar", "Bridge work", 5.5)], summary="Moved a berth")
    assert build_profiles(employees(spark, rows)).first()["profile_text"] == (
        "Employee Profile\nPrimary Domain: Marine Cargo\nDomain Experience: 8 years\nTotal Experience: 12 years\n"
        "Past Project Summary: Moved a berth\nSkills:\n"
        "- Skill: Rigging | Category: Deck work | Experience: 6 years\n"
        "- Skill: Radar | Category: Bridge work | Experience: 5.5 years"
    )


def test_repeated_skills_first_for_text_last_for_score_raw_in_list(spark):
    rows = employee_rows("E1", [
        (" Rigging ", "A", 1.0), ("rigging", "B", 2.0), ("", "C", 3.0), ("\tRadar ", "D", 4.0), (None, "E", 5.0),
        ("RIGGING", "F", 7.0), ("  ", "G", 9.0), ("rigging", "H", 3.0),
    ])
    p = build_profiles(employees(spark, rows)).first()
    assert p["skills"] == [" Rigging ", "rigging", "", "\tRadar ", "RIGGING", "  "]
    assert p["skill_years"] == {"rigging": 3.0, "radar": 4.0, "": 9.0}
    assert p["profile_text"].split("Skills:\n")[1] == (
        "- Skill: Rigging | Category: A | Experience: 1 years\n- Skill: Radar | Category: D | Experience: 4 years")


def test_header_comes_from_first_row_whatever_the_arrival_order(spark):
    rows = employee_rows("E1", [("a", "x", 1.0)], domain="Late", start=9) + employee_rows(
        "E1", [("b", "x", 1.0)], domain="Early", start=2)
    frame = employees(spark, rows)
    for parts in (1, 3, 7):
        p = build_profiles(frame.repartition(parts)).first()
        assert (p["domain"], p["skills"]) == ("Early", ["b", "a"])


def test_employee_without_skills_keeps_an_empty_block(spark):
    p = build_profiles(employees(spark, employee_rows("E1", [("", "x", 1.0)]))).first()
    assert p["profile_text"].endswith("Skills:\n") and p["skills"] == [""] and p["skill_years"] == {}


def test_requirement_embedding_text_bullets(spark):
    frame = requirements(
        spark,
        requirement("R1", [("Rigging", "Deck work", 5.0), ("Radar", "  ", None), (None, None, 0.0)],
                    [("Harbours", "DOMAIN", 3.0)], years=4.5, domain=("Retail", "Web")),
        requirement("R2", domain=None, description=None),
    )
    got = {r[0]: r[1] for r in frame.select("requirement_id", tx.requirement_embedding_text()).collect()}
    assert got["R1"] == (
        "Employee Profile\nPrimary Domain: Retail, Web\nDomain Experience: 4.5 years\nTotal Experience: 4.5 years\n"
        "Past Project Summary: New desk\nSkills:\n- Skill: Rigging | Category: Deck work | Experience: 5 years\n"
        "- Skill: Radar | Category: General\n- Skill:  | Category: General\n"
        "- Skill: Harbours | Category: DOMAIN | Optional")
    assert got["R2"] == (
        "Employee Profile\nPrimary Domain: N/A\nDomain Experience: 0 years\nTotal Experience: 0 years\n"
        "Past Project Summary: N/A\nSkills:\nNone")


def test_requirement_display_text(spark):
    frame = requirements(
        spark,
        requirement("R1", [("A", "c", 2.0), ("B", "", 1.5), ("C", "d", None), ("D", None, 0.0)], years=3.0),
        requirement("R2", domain=(), description=None, criticality=None, months=None, bandwidth=None),
    )
    got = {r[0]: r[1] for r in frame.select("requirement_id", tx.requirement_display_text()).collect()}
    assert got["R1"] == (
        "Project Description:\nNew desk\n\nDomain: Marine Cargo\nCriticality: High\nDuration: 6 months\n"
        "Required Bandwidth: 50%\nMinimum Overall Experience: 3 years\n\nMandatory Skills:\n"
        "A (2 years, c), B (1.5 years), C (d), D\n\nOptional Skills:\nNone")
    assert "Domain: N/A\nCriticality: N/A\nDuration: N/A months\nRequired Bandwidth: N/A%" in got["R2"]


def test_strip_and_number_text(spark):
    frame = spark.createDataFrame([(" \t a b \x1f ", 8.0), ("x", 8.25), (None, None)], "s string, n double")
    rows = frame.select(tx.strip(F.col("s")), tx.number_text(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("a b", "8"), ("x", "8.25"), (None, None)]
