"""Plan shapes the scale rules depend on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import spark_queries as q
from staffmatch.operators import ivf
from staffmatch.operators.knn import KnnOptions
from staffmatch.operators.profiles import build_profiles
from staffmatch.plans.match import candidates, match
from staffmatch.sources import staffing as st
from staffmatch.sources.requirements import parse_requirements


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    build_profiles(st.employees(spark, sf)).write.parquet(f"{folder}/profiles")
    vectors = st.active_vectors(spark, sf)
    centroids = np.eye(8, 64)
    ivf.assign_cells(vectors, centroids).write.partitionBy("cell").parquet(f"{folder}/cells")
    vectors.write.parquet(f"{folder}/vectors")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("profiles", "cells", "vectors")} | {"centroids": centroids}


@pytest.mark.parametrize("options", [KnnOptions(), KnnOptions(plan="grid", seed_fraction=0.2)])
def test_match_has_no_cross_join_and_limits_before_the_shuffle(spark, sf, stored, options):
    text = plan(match(st.requirements(spark, sf), stored["profiles"], stored["vectors"], options=options))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text


def test_broadcast_search_does_not_shuffle_vectors(spark, sf, stored):
    text = plan(candidates(st.requirements(spark, sf), stored["vectors"]))
    assert text.count("Exchange hashpartitioning") <= 1 or text.count(") Exchange") == 1
    assert "MapInArrow" in text


def test_match_reads_only_the_profile_columns_it_needs(spark, sf, stored):
    text = plan(match(st.requirements(spark, sf), stored["profiles"], stored["vectors"]))
    assert "profile_text" not in text and "past_project_execution_summary" not in text


def test_ivf_search_prunes_cell_partitions(spark, sf, stored):
    found = candidates(st.requirements(spark, sf).limit(1), stored["cells"], centroids=stored["centroids"], nprobe=2)
    text = plan(found)
    assert "PartitionFilters: [isnotnull(cell" in text or "PartitionFilters: [cell" in text


def test_matching_profiles_never_read_the_summaries(spark, sf):
    text = plan(build_profiles(st.employees(spark, sf), with_text=False))
    assert "past_project_execution_summary" not in text


def test_replies_are_parsed_once(spark, sf):
    ok, bad = parse_requirements(st.requirement_replies(spark, sf))
    for df in (ok, bad):
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("from_json(") == 1 and physical.count("parseJson(") == 1


def test_active_rows_are_pushed_to_the_registry_scan(spark, store):
    from staffmatch.operators.encode import HashingEncoder
    from staffmatch.plans import embeddings as eb
    from tests.helpers import employee_rows, employees

    encoder = HashingEncoder(4)
    eb.sync_embeddings(store, employees(spark, employee_rows("1", [("Go", "L", 1.0)])), encoder)
    text = plan(eb.read_registry(store, encoder.model, active_only=True).select("employee_id"))
    assert "EqualTo(is_active,true)" in text
    assert "PartitionFilters: [isnotnull(model" in plan(eb.read_vectors(store, encoder.model))


def test_one_large_employee_and_one_large_requirement_side(spark):
    """A third of all rows on one employee; results equal a direct computation."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("employee_id"),
        F.col("id").alias("row_seq"), F.lit("n").alias("employee_name"), F.lit("d").alias("domain"),
        F.lit(1.0).alias("domain_experience_years"), F.lit(1.0).alias("total_experience_years"),
        F.lit(100.0).alias("current_bandwidth_percent"), F.lit("s").alias("past_project_execution_summary"),
        F.concat(F.lit("s"), F.col("id") % 40).alias("skill"), F.lit("c").alias("skill_category"),
        (F.col("id") % 11).cast("double").alias("skill_experience_years"),
    )
    big = build_profiles(rows).where("employee_id = 'big'").first()
    ids = [i for i in range(6000) if i % 3 == 0]
    assert big["skills"] == list(dict.fromkeys(f"s{i % 40}" for i in ids))
    assert big["skill_years"] == {f"s{i % 40}": float(i % 11) for i in ids}


def test_registered_queries_have_matching_names():
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries()) >= set(q.QUERIES)


def test_a_requirement_without_matches_has_an_empty_list(spark):
    from staffmatch.plans.results import requirement_results
    from tests.helpers import requirement, requirements

    matches = spark.createDataFrame([("R1", 2, "b", 3), ("R1", 1, "a", 3)], "requirement_id string, rank int, employee_id string, total_matches bigint")
    rows = {r["requirement_id"]: r for r in requirement_results(requirements(spark, requirement("R1"), requirement("R2")), matches).collect()}
    assert [tuple(x) for x in rows["R1"]["results"]] == [(1, "a"), (2, "b")] and rows["R1"]["total_matches"] == 3
    assert rows["R2"]["results"] == [] and rows["R2"]["total_matches"] == 0 and rows["R2"]["record"]["project_description"] == "New desk"
