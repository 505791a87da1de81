"""Everything there is to say about a requirement, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import REQUIREMENT_BODY


def requirement_results(requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """``requirement_id, record, display_text, embedding_text, total_matches, results``, one row per requirement.

    ``record`` holds the parsed fields, ``results`` the matches as structs in the order of their ranks; an explanation
    or any other column beside the match columns goes along. ``matches`` is cut to the first ranks already, so a list
    is no longer than that; a requirement without matches has an empty one.
    """
    columns = [c for c in matches.columns if c not in ("requirement_id", "rank", "total_matches")]
    entry = F.struct("rank", *columns)
    found = matches.groupBy("requirement_id").agg(
        F.array_sort(F.collect_list(entry)).alias("results"), F.max("total_matches").alias("total_matches"))
    rows = requirements.select(
        "requirement_id", F.struct(*REQUIREMENT_BODY.fieldNames()).alias("record"),
        tx.requirement_display_text().alias("display_text"), tx.requirement_embedding_text().alias("embedding_text"))
    nothing = F.array().cast(found.schema["results"].dataType)
    return rows.join(found, "requirement_id", "left").select(
        "requirement_id", "record", "display_text", "embedding_text",
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"), F.coalesce("results", nothing).alias("results"))
