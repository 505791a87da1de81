"""Small builders for test tables."""

from staffmatch.schemas import EMPLOYEE_SKILL, REQUIREMENT


def employee_rows(employee_id, skills, *, domain="Marine Cargo", domain_years=8.0, total_years=12.0,
                  bandwidth=60.0, name=None, summary="Built a berth planner", start=1):
    """``skills``: (skill, category, years) tuples in file order."""
    return [
        (employee_id, start + i, name or f"Name {employee_id}", domain, domain_years, total_years, bandwidth, summary,
         skill, category, years)
        for i, (skill, category, years) in enumerate(skills)
    ]


def employees(spark, *groups):
    return spark.createDataFrame([r for g in groups for r in g], EMPLOYEE_SKILL)


def requirement(requirement_id="R1", mandatory=(), optional=(), years=None, domain=("Marine Cargo",),
                description="New desk", criticality="High", months=6.0, bandwidth=50.0):
    return (requirement_id, description, list(domain) if domain is not None else None, criticality, months, bandwidth,
            years, list(mandatory), list(optional))


def requirements(spark, *rows):
    return spark.createDataFrame(list(rows), REQUIREMENT)
