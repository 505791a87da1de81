"""Table schemas. Every table is keyed; nothing depends on row position."""

from __future__ import annotations

from pyspark.sql import types as T

EMPLOYEE_SKILL = T.StructType([
    T.StructField("employee_id", T.StringType(), False),
    T.StructField("row_seq", T.LongType(), False),
    T.StructField("employee_name", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("domain_experience_years", T.DoubleType(), False),
    T.StructField("total_experience_years", T.DoubleType(), False),
    T.StructField("current_bandwidth_percent", T.DoubleType(), False),
    T.StructField("past_project_execution_summary", T.StringType()),
    T.StructField("skill", T.StringType()),
    T.StructField("skill_category", T.StringType()),
    T.StructField("skill_experience_years", T.DoubleType(), False),
])

SKILL_ITEM = T.StructType([
    T.StructField("skill", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("min_experience_years", T.DoubleType()),
])

REQUIREMENT_BODY = T.StructType([
    T.StructField("project_description", T.StringType()),
    T.StructField("domain", T.ArrayType(T.StringType())),
    T.StructField("project_criticality", T.StringType()),
    T.StructField("project_duration_months", T.DoubleType()),
    T.StructField("required_bandwidth_percentage", T.DoubleType()),
    T.StructField("minimum_overall_experience_years", T.DoubleType()),
    T.StructField("mandatory_skills", T.ArrayType(SKILL_ITEM)),
    T.StructField("optional_skills", T.ArrayType(SKILL_ITEM)),
])

REQUIREMENT = T.StructType([T.StructField("requirement_id", T.StringType())] + REQUIREMENT_BODY.fields)

REQUIREMENT_RAW = T.StructType([
    T.StructField("requirement_id", T.StringType()),
    T.StructField("raw", T.StringType()),
])

EMBEDDING = T.StructType([
    T.StructField("employee_id", T.StringType(), False),
    T.StructField("vector_id", T.LongType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType()), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
])

# Compacted vectors of one model; the version is that of the vector, not of the table.
BASE_VECTORS = T.StructType(EMBEDDING.fields[:3] + EMBEDDING.fields[4:])

REGISTRY = T.StructType([
    T.StructField("employee_id", T.StringType()),
    T.StructField("vector_id", T.LongType()),
    T.StructField("vector_version", T.LongType()),
    T.StructField("replaced", T.BooleanType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("embedded_at", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("action", T.StringType()),
    T.StructField("model", T.StringType()),
])

INDEX_CATALOG = T.StructType([
    T.StructField("index_name", T.StringType()),
    T.StructField("index_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("nlist", T.IntegerType()),
    T.StructField("nprobe", T.IntegerType()),
    T.StructField("vector_count", T.LongType()),
    T.StructField("build", T.LongType()),
    T.StructField("parts", T.LongType()),
    T.StructField("vector_version", T.LongType()),
    T.StructField("seed", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

MANIFEST = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("path", T.StringType()),
])

MATCH_COLUMNS = [
    "requirement_id", "rank", "employee_id", "employee_name", "domain", "total_experience_years",
    "current_bandwidth_percent", "skills", "similarity", "rule_score", "calibrated_rule_score",
    "final_rank", "confidence", "total_matches",
]
