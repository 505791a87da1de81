import pytest

from staffmatch.operators.profiles import build_profiles, number_rows
from staffmatch.sources.employees import read_employee_csv, load_employees, read_snapshot, save_snapshot
from staffmatch.sources.requirements import parse_requirements, read_requirement_texts

HEADER = ("skill,Unnamed: 0,employee_id,employee_name,domain,domain_experience_years,total_experience_years,"
          "current_bandwidth_percent,past_project_execution_summary,skill_category,skill_experience_years,")


def test_csv_by_name_with_quarantine(spark, tmp_path):
    path = tmp_path / "staff.CSV"
    path.write_text(HEADER + "\n"
                    'Python,0,1,Ann,Retail,8,12,60,"two\nlines, ""quoted""",Programming,6,\n'
                    "SQL,1,1,Ann,Retail,8,12,60,x,,5.5,\n"
                    ",2,2,Bob,,3,4,,x,Tools,1,\n"
                    "Go,3,3,Cy,Web,many,4,50,x,Tools,,\n"
                    "Go,4,,Di,Web,1,4,50,x,Tools,2,\n", encoding="utf-8")
    clean, bad = load_employees(spark, str(path))
    rows = clean.orderBy("row_seq").collect()
    assert [(r["employee_id"], r["skill"], r["skill_experience_years"]) for r in rows] == [("1", "Python", 6.0), ("1", "SQL", 5.5)]
    assert rows[0]["past_project_execution_summary"] == 'two\nlines, "quoted"' and rows[1]["skill_category"] == ""
    reasons = {r["employee_id"]: r["reason"] for r in bad.collect()}
    assert reasons == {
        "2": "current_bandwidth_percent is not a number",
        "3": "domain_experience_years is not a number; skill_experience_years is not a number",
        None: "employee_id is empty",
    }
    assert "Unnamed: 0" not in clean.columns and not [c for c in clean.columns if c.startswith("_c")]


def test_absent_columns_take_defaults(spark, tmp_path):
    path = tmp_path / "few.csv"
    path.write_text("employee_id,domain,domain_experience_years,total_experience_years,skill,skill_experience_years\n"
                    "E1,Web,1,2,Go,3\n")
    clean, bad = load_employees(spark, str(path))
    row = clean.first()
    assert row["current_bandwidth_percent"] == 100.0 and bad.count() == 0
    assert "Past Project Summary: N/A" in build_profiles(clean).first()["profile_text"]
    with pytest.raises(ValueError, match="must be .csv"):
        load_employees(spark, str(tmp_path / "few.xlsx"))


def test_snapshot_is_replaced_and_missing_one_is_reported(spark, store, tmp_path):
    with pytest.raises(FileNotFoundError, match="load employees first"):
        read_snapshot(store)
    path = tmp_path / "a.csv"
    path.write_text("employee_id,domain,domain_experience_years,total_experience_years,skill,skill_experience_years\n"
                    "E1,Web,1,2,Go,3\nE2,Web,1,2,Go,3\n")
    clean, _ = load_employees(spark, str(path))
    assert save_snapshot(store, clean) == {"version": 1, "rows_loaded": 2}
    assert save_snapshot(store, read_snapshot(store).where("employee_id = 'E2'"))["rows_loaded"] == 1
    assert [r["employee_id"] for r in read_snapshot(store).collect()] == ["E2"]


def test_requirement_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Zwei Entwickler für Köln\nbitte", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("one", encoding="utf-8")
    (tmp_path / "c.md").write_text("no", encoding="utf-8")
    got = {r["source_file"]: r["requirement_text"] for r in read_requirement_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Zwei Entwickler für Köln\nbitte", "b.TXT": "one"}


def test_reply_parsing_and_error_classes(spark):
    good = '{"project_description": "d", "domain": ["x"], "mandatory_skills": [{"skill": "Go", "category": null, "min_experience_years": 2}], "more": 1}'
    replies = [
        ("plain", good), ("fenced", f"```json\n{good}\n```"), ("bare fence", f"```\n{good}```  "), ("missing keys", "{}"),
        ("cut", good[: len(good) // 2]), ("single quotes", "{'domain': []}"), ("blank", ""), ("null", None),
        ("flat domain", '{"domain": "x"}'), ("plain skills", '{"mandatory_skills": ["Go"]}'),
        ("bad number", '{"project_duration_months": "soon"}'), ("list", f"[{good}]"), ("number", "5"),
    ]
    ok, bad = parse_requirements(spark.createDataFrame(replies, "requirement_id string, raw string"))
    parsed = {r["requirement_id"]: r for r in ok.collect()}
    assert set(parsed) == {"plain", "fenced", "bare fence", "missing keys"}
    assert parsed["fenced"]["mandatory_skills"][0].asDict() == {"skill": "Go", "category": None, "min_experience_years": 2.0}
    assert parsed["missing keys"]["domain"] is None
    errors = {r["requirement_id"]: (r["error"], r["raw_output"]) for r in bad.collect()}
    for name in ("cut", "single quotes", "blank", "null"):
        assert errors[name][0] == "JSON parsing failed"
    for name in ("flat domain", "plain skills", "bad number", "list", "number"):
        assert errors[name][0] == "Extraction failed"
    assert errors["cut"][1] == good[: len(good) // 2]


def test_row_numbers_equal_a_plain_window_for_a_large_key(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("employee_id"),
        (F.col("id") * 7919 % 3001).alias("at"))
    got = number_rows(rows, "employee_id", ["at"], F.floor(F.col("at") / 100))
    want = rows.withColumn("row_seq", F.row_number().over(W.partitionBy("employee_id").orderBy("at")).cast("bigint"))
    assert sorted(map(tuple, got.select("employee_id", "at", "row_seq").collect())) == sorted(map(tuple, want.collect()))


def test_work_folder_follows_the_session_setting(spark):
    from staffmatch.sources.tables import work_folder

    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_rows_of_split_files_come_in_file_order(spark, tmp_path, split):
    folder = tmp_path / "staff"
    folder.mkdir()
    want = []
    for f in range(3):
        rows = [f"E{f}{i:03d},Go{i},{'x' * (i % 40)}" for i in range(150 - 60 * f)]
        (folder / f"part-{f}.csv").write_text("employee_id,skill,domain\n" + "\n".join(rows) + "\n")
        want += [r.split(",")[0] for r in rows]
    (folder / "empty.CSV").write_text("employee_id,skill,domain\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_employee_csv(spark, str(folder), multi_line=False)
        got = sorted((r["row_seq"], r["employee_id"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(enumerate(want, 1))
