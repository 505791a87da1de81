"""Ranked matches for a whole table of requirements in one plan.

candidates (top-k join) -> profile and requirement joins -> rule score -> final rank -> top-n window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions.numeric import round_half_up
from ..operators import ivf
from ..operators.knn import KnnOptions, keep_top, top_k, with_floors
from ..operators.scoring import score_pairs
from ..schemas import MATCH_COLUMNS
from ..sources.tables import work_folder

# Fixed values of the request defaults.
CANDIDATE_K = 50
TOP_N = 20


def pool_size(top_n: int, candidate_k: int | None) -> int:
    """The given pool, or the default one, never below what is to be returned."""
    if top_n < 1:
        raise ValueError(f"top_n must be at least 1, got {top_n}")
    if candidate_k is None:
        return max(CANDIDATE_K, top_n)
    if candidate_k < top_n:
        raise ValueError(f"a pool of {candidate_k} candidates cannot give {top_n} matches")
    return candidate_k


def candidates(requirements: DataFrame, vectors: DataFrame, candidate_k: int = CANDIDATE_K, *,
               centroids=None, nprobe: int | None = None, reach=None, cell_sizes: DataFrame | None = None,
               options: KnnOptions = KnnOptions(), vector_count: int | None = None) -> DataFrame:
    """Candidate pool per requirement; with ``centroids`` only the ``nprobe`` nearest cells are searched.

    With ``reach`` (``ivf.read_reach``) the search is exact: the nearest cells give a k-th similarity, and only cells
    whose bound reaches it are searched after them. ``vectors`` holds live employees only, so the pool is never
    thinned out afterwards.
    """
    if centroids is None:
        return top_k(requirements, vectors, candidate_k, options=options, item_count=vector_count)
    probes = ivf.probe_cells(requirements, centroids, len(centroids) if nprobe is None else nprobe)

    def search(some: DataFrame) -> DataFrame:
        return top_k(some, vectors, candidate_k, cells=True, options=options, item_count=vector_count,
                     cell_count=len(centroids), cell_sizes=cell_sizes)

    if reach is None:
        return search(probes)
    spark, folder = requirements.sparkSession, work_folder(requirements.sparkSession)

    def kept(rows: DataFrame, name: str) -> DataFrame:  # read more than once, and an encoder may stand before it
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    probes = kept(probes, "probes")
    first = kept(search(probes), "first")
    rest = kept(ivf.cells_within(with_floors(probes, first, candidate_k), centroids, reach).where(F.size("cells") > 0), "rest")
    return keep_top(first.drop("candidate_rank").unionByName(search(rest).drop("candidate_rank")), candidate_k)


def rank_pairs(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """Final rank, confidence, position and pool size; cut to ``top_n`` per requirement when given."""
    by_requirement = W.partitionBy("requirement_id")
    order = by_requirement.orderBy(F.col("final_rank").desc(), F.col("similarity").desc(), "employee_id")
    ranked = (
        scored.withColumn("final_rank", nm.final_rank(F.col("similarity"), F.col("calibrated_rule_score")))
        .withColumn("confidence", nm.confidence(F.col("final_rank")))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("total_matches", F.count("*").over(by_requirement))
    )
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def match(
    requirements: DataFrame,
    profiles: DataFrame,
    vectors: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    weights_column: str | None = None,
    candidate_k: int | None = None,
    top_n: int = TOP_N,
    use_skill_years: bool = False,
    centroids=None,
    nprobe: int | None = None,
    reach=None,
    cell_sizes: DataFrame | None = None,
    options: KnnOptions = KnnOptions(),
    vector_count: int | None = None,
) -> DataFrame:
    """The ``top_n`` employees per requirement.

    ``requirements``: one row per ``requirement_id`` with ``vec``; ``profiles``: ``build_profiles`` output
    or its stored table; ``vectors``: unit vectors of live employees (with ``cell`` for an IVF search).
    ``candidate_k`` is the pool before rule scoring: 50, or ``top_n`` where more are wanted; a pool below
    ``top_n`` is an error.
    """
    candidate_k = pool_size(top_n, candidate_k)
    pool = candidates(requirements, vectors, candidate_k, centroids=centroids, nprobe=nprobe, reach=reach,
                      cell_sizes=cell_sizes, options=options, vector_count=vector_count)
    scored = score_pairs(pool, profiles, requirements, weights, weights_column=weights_column,
                         use_skill_years=use_skill_years)
    return rank_pairs(scored, top_n).withColumn("similarity", round_half_up(F.col("similarity"), 4)).select(MATCH_COLUMNS)
