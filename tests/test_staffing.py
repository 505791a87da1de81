from staffmatch.operators.profiles import build_profiles, employee_headers
from staffmatch.sources import staffing as st


def tables(spark, folder):
    """Three people, two of them under ids that are cut to the same 12 digits, and lines in several orders."""
    rows = {
        "customer": [(1, "A", 0, 1.0, "X"), (1234567890123, "B", 1, 1.0, "Y"), (1234567890124, "C", 1, 1.0, "Z")],
        "orders": [(1, 1), (2, 1), (3, 1234567890123), (4, 1234567890124), (5, None)],
        "lineitem": [(o, 1 + n % 2, n, n, float(n), 1.0) for o in range(1, 6) for n in range(1, 4)],
        "part": [(1, "Go", "L"), (2, "SQL", None)],
        "documents": [(i, f"text {i}") for i in range(3)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, st.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_rows_stay_with_their_person(spark, tmp_path):
    found = st.employees(spark, tables(spark, tmp_path)).groupBy("employee_id", "employee_name", "past_project_execution_summary").count().collect()
    assert sorted(tuple(r) for r in found) == [
        ("EMP000000000001", "A", "text 1", 6), ("EMP123456789012", "B", "text 0", 3), ("EMP123456789012", "C", "text 1", 3)]


def test_rows_with_texts_are_neither_moved_nor_sorted_for_the_headers(spark, tmp_path):
    people = st.employees(spark, tables(spark, tmp_path))
    plan = employee_headers(people)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0]
    assert "SortMergeJoin" in plan and "Exchange" not in above and "Sort [" not in above
    assert build_profiles(people).count() == 2
