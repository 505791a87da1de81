"""Staffing view over the star-schema tables: employees, requirements, vectors, stored replies.

Used by the registered queries, the tests and the bench; every mapping runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .tables import spread

MODEL = "table/64"


# Columns in use; a given schema spares the footer-reading job of schema inference.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_name string",
    "documents": "doc_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def employee_id(key: F.Column) -> F.Column:
    return F.concat(F.lit("EMP"), F.lpad(key.cast("string"), 12, "0"))


def requirement_id(key: F.Column) -> F.Column:
    return F.concat(F.lit("REQ"), F.lpad(key.cast("string"), 12, "0"))


def employees(spark: SparkSession, sf_dir: str, summaries: bool = True) -> DataFrame:
    """One row per line item: its customer is the employee, the brand of its part the skill.

    Without ``summaries`` the document text is left null and the documents are not read. With them, lines and people meet
    sorted by ``employee_id``, so that what groups the rows by employee neither moves nor sorts them with the text.
    """
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    lineitem, part = spread(table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "part")
    k = F.col("c_custkey")
    if summaries:
        documents = table(spark, sf_dir, "documents")
        n_documents = documents.select(F.count("*")).scalar()
        customer = customer.withColumn("doc_id", k % n_documents).join(
            documents.select("doc_id", "text"), "doc_id", "left"
        )
    else:
        customer = customer.withColumn("text", F.lit(None).cast("string"))
    people = customer.select(
        k,
        employee_id(k).alias("person_id"),
        F.col("c_name").alias("employee_name"),
        F.col("c_mktsegment").alias("domain"),
        (1 + (k * 5) % 12).cast("double").alias("domain_experience_years"),
        (3 + (k * 7) % 18).cast("double").alias("total_experience_years"),
        (((k * 13) % 21) * 5).cast("double").alias("current_bandwidth_percent"),
        F.col("text").alias("past_project_execution_summary"),
    )
    # File order: by order and line; the lower part tells lines with the same order and line number apart.
    below = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_quantity").cast("bigint") * 15485863) % 1048573
    line_order = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + below
    lines = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "o_custkey",
            employee_id(F.col("o_custkey")).alias("employee_id"),
            line_order.alias("row_seq"),
            # Some skills are blank, padded or in another case, some categories are missing, some years are half.
            F.when(F.col("l_suppkey") % 41 == 0, F.lit("")).when(F.col("l_suppkey") % 41 == 1, F.lit("  "))
            .when(F.col("l_suppkey") % 41 == 2, F.concat(F.lit(" "), "p_brand", F.lit("  ")))
            .when(F.col("l_suppkey") % 41 == 3, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("skill"),
            F.when(F.col("l_suppkey") % 7 != 6, F.col("p_type")).alias("skill_category"),
            ((1 + F.col("l_quantity").cast("bigint") % 12).cast("double") + F.when(F.col("l_suppkey") % 5 == 4, 0.5).otherwise(0.0))
            .alias("skill_experience_years"),
        )
    )
    same = F.col("o_custkey") == F.col("c_custkey")
    if summaries:  # ids are cut to 12 digits, so the keys are compared too, by a condition that is no key of the join
        people = people.hint("merge")
        same = (F.col("employee_id") == F.col("person_id")) & (F.col("o_custkey") - F.col("c_custkey") == 0)
    return lines.join(people, same).select(
        F.col("employee_id" if summaries else "person_id").alias("employee_id"), "row_seq", "employee_name", "domain", "domain_experience_years", "total_experience_years",
        "current_bandwidth_percent", "past_project_execution_summary", "skill", "skill_category",
        "skill_experience_years",
    )


def employee_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every customer, shared by customers whose numbers differ by the number of vectors."""
    customer, embeddings = table(spark, sf_dir, "customer"), table(spark, sf_dir, "embeddings")
    n_vectors = embeddings.select(F.count("*")).scalar()
    eid = employee_id(F.col("c_custkey"))
    return customer.withColumn("vec_id", F.col("c_custkey") % n_vectors).join(embeddings, "vec_id").select(
        eid.alias("employee_id"), vx.vector_id(eid).alias("vector_id"), F.col("embedding").alias("vec")
    )


def active_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids present in the employee table (customers with at least one line item)."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    with_lines = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    customer = table(spark, sf_dir, "customer")
    return customer.join(with_lines, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        employee_id(F.col("c_custkey")).alias("employee_id")
    )


def active_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employee_vectors(spark, sf_dir).join(active_ids(spark, sf_dir), "employee_id", "left_semi")


def requirements(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """One requirement per supplier, with ``vec`` and its number ``s`` (used by fixtures only)."""
    supplier = table(spark, sf_dir, "supplier")
    s = F.col("s_suppkey")
    segments = [F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]

    def years(value):
        return F.when(value != 0, value.cast("double"))

    def item(skill, category, min_years):
        return F.struct(
            skill.alias("skill"), category.alias("category"), min_years.cast("double").alias("min_experience_years")
        )

    def brand(n):
        return F.concat(F.lit("Brand#"), (1 + n % 25).cast("string"))

    mandatory = F.array(*[
        item(brand(s * 3 + j * 7), F.when((s + j) % 4 == 0, F.lit("")).otherwise(F.lit("Tech")), years((s + j) % 6))
        for j in range(3)
    ])
    optional = F.array(item(brand(s * 3 + 11), F.lit("Tools"), F.lit(None)))
    rows = supplier.select(
        s.alias("s"),
        requirement_id(s).alias("requirement_id"),
        F.concat(F.lit("Project for "), "s_name").alias("project_description"),
        F.when(s % 7 != 6, F.array(F.get(F.array(*segments), (s % 5).cast("int"))))
        .otherwise(F.array().cast("array<string>")).alias("domain"),
        F.get(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (s % 3).cast("int")).alias("project_criticality"),
        (1 + s % 24).cast("double").alias("project_duration_months"),
        ((s % 5) * 25).cast("double").alias("required_bandwidth_percentage"),
        years(s % 11).alias("minimum_overall_experience_years"),
        F.when(s % 13 != 12, mandatory).otherwise(F.slice(mandatory, 1, 0)).alias("mandatory_skills"),
        F.when(s % 4 != 3, optional).otherwise(F.slice(optional, 1, 0)).alias("optional_skills"),
    )
    if not with_vectors:
        return rows
    embeddings = table(spark, sf_dir, "embeddings")
    n_vectors = embeddings.select(F.count("*")).scalar()
    return rows.withColumn("vec_id", F.col("s") % n_vectors).join(embeddings, "vec_id").withColumnRenamed("embedding", "vec").drop("vec_id")


def requirement_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON replies, some inside fences, some broken: ``s, requirement_id, raw``."""
    rows = requirements(spark, sf_dir, with_vectors=False)
    s = F.col("s")
    body = [c for c in rows.columns if c not in ("s", "requirement_id")]
    good = F.to_json(F.struct(*body))
    flat_domain = F.to_json(F.struct(*[F.coalesce(F.get("domain", F.lit(0)), F.lit("")).alias(c) if c == "domain" else F.col(c) for c in body]))
    shaped = F.when(s % 10 == 8, flat_domain).otherwise(good)
    cut = F.when(s % 10 == 9, F.substring(shaped, F.lit(1), (F.length(shaped) / 2).cast("int"))).otherwise(shaped)
    fenced = F.when(s % 3 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    return rows.select("s", "requirement_id", fenced.alias("raw"))
