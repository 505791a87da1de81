"""Headline timings. Prints one JSON line: seconds per query (warm, median), rates and IVF recall.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_REPEATS (timed runs per query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from checks import spark_queries as q  # noqa: E402
from staffmatch.operators import ivf  # noqa: E402
from staffmatch.operators import profiles as pf  # noqa: E402
from staffmatch.operators.encode import HashingEncoder  # noqa: E402
from staffmatch.plans import embeddings as eb  # noqa: E402
from staffmatch.plans.match import candidates, match  # noqa: E402
from staffmatch.sources import staffing as st  # noqa: E402
from staffmatch.sources.requirements import parse_requirements  # noqa: E402
from staffmatch.sources.tables import TableStore, work_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    folder = work_folder(spark)
    vectors = st.active_vectors(spark, SF_DIR)
    requirements = st.requirements(spark, SF_DIR)
    # Stored inputs, as in operation: profiles, vectors and requirements are tables.
    pf.build_profiles(st.employees(spark, SF_DIR, False), with_text=False).write.parquet(f"{folder}/profiles")
    vectors.write.parquet(f"{folder}/vectors")
    requirements.write.parquet(f"{folder}/requirements")
    stored_profiles, stored_vectors, stored_requirements = (
        spark.read.parquet(f"{folder}/{n}") for n in ("profiles", "vectors", "requirements"))
    st.requirement_replies(spark, SF_DIR).write.parquet(f"{folder}/replies")
    stored_replies = spark.read.parquet(f"{folder}/replies")
    n_requirements = stored_requirements.count()
    centroids = ivf.train_centroids(stored_vectors, 20)
    ivf.assign_cells(stored_vectors, centroids).write.partitionBy("cell").parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")

    jobs = {
        "match_top_n": lambda: finish(q.match_top_n(spark, SF_DIR)),
        "match_stored_exact": lambda: finish(match(stored_requirements, stored_profiles, stored_vectors)),
        "match_stored_ivf": lambda: finish(
            match(stored_requirements, stored_profiles, cells, centroids=centroids, nprobe=10)),
        "knn_exact": lambda: finish(candidates(stored_requirements, stored_vectors)),
        "knn_exact_grid": lambda: finish(candidates(stored_requirements, stored_vectors, options=q.KnnOptions(plan="grid"))),
        "profile_text": lambda: finish(q.profile_text(spark, SF_DIR)),
        "requirement_parsed": lambda: finish(parse_requirements(stored_replies)[0]),
        "requirement_embedding_text": lambda: finish(q.requirement_embedding_text(spark, SF_DIR)),
    }
    seconds = {}
    for name, job in jobs.items():
        job()
        seconds[name] = round(statistics.median(timed(job) for _ in range(REPEATS)), 3)

    # Sync: first load without office 0, nothing new, then office 0 joins and office 1 leaves.
    store, encoder = TableStore(spark, f"{folder}/store"), HashingEncoder(256)
    employees = st.employees(spark, SF_DIR)
    joined_late, left, _, _ = q._office_snapshots(spark, SF_DIR)
    before = employees.join(joined_late.select("employee_id"), "employee_id", "left_semi")
    after = employees.join(left.select("employee_id"), "employee_id", "left_semi")
    for name, rows in (("sync_first_load", before), ("sync_no_change", before), ("sync_join_and_leave", after)):
        seconds[name] = round(timed(lambda rows=rows: eb.sync_embeddings(store, rows, encoder)), 3)

    exact = {(r[0], r[1]) for r in candidates(stored_requirements, stored_vectors).select("requirement_id", "employee_id").collect()}
    recall = {}
    for nprobe in (1, 5, 10, 20):
        found = candidates(stored_requirements, cells, centroids=centroids, nprobe=nprobe)
        hits = {(r[0], r[1]) for r in found.select("requirement_id", "employee_id").collect()} & exact
        recall[str(nprobe)] = round(len(hits) / max(len(exact), 1), 4)

    n_profiles = stored_profiles.count()
    print(json.dumps({
        "metric": "staff matching, sum of warm query medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "rates": {
            "match_exact_requirements_per_s": round(n_requirements / seconds["match_stored_exact"], 1),
            "match_ivf_requirements_per_s": round(n_requirements / seconds["match_stored_ivf"], 1),
            "profile_texts_per_s": round(n_profiles / seconds["profile_text"], 1),
            "parsed_replies_per_s": round(st.table(spark, SF_DIR, "supplier").count() / seconds["requirement_parsed"], 1),
        },
        "ivf_recall_at_50_by_nprobe": recall,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
