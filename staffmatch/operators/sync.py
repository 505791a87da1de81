"""Labelling of employee ids against the embedding registry.

One full outer join on ``employee_id`` (unique on both sides, so evenly spread) gives every label:

    in snapshot, not registered            NEW          embed, insert active
    in snapshot, registered, active        KEEP         (CHANGE when its text differs, if asked for)
    in snapshot, registered, inactive      REACTIVATE   flip to active, vector reused
    not in snapshot, registered, active    DELETE       flip to inactive, vector kept
    not in snapshot, registered, inactive  ABSENT       unchanged
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_id

EMBED_ACTIONS = ["NEW", "CHANGE"]


def unsure_ids(prints: DataFrame, registry: DataFrame) -> DataFrame:
    """``employee_id`` of the snapshot whose fingerprint is not the registered one: only their texts need a look."""
    known = registry.where("text_hash IS NOT NULL").select("employee_id", "fingerprint")
    return prints.join(known, ["employee_id", "fingerprint"], "left_anti").select("employee_id")


def label_ids(current: DataFrame, registry: DataFrame, detect_changes: bool = False) -> DataFrame:
    """Registry columns plus ``action`` for every id known to either side.

    ``current``: distinct ``employee_id``; with ``detect_changes`` also ``fingerprint`` and ``text_hash``, the latter
    null where the fingerprint is the registered one.
    """
    none = F.lit(None).cast("string")
    now = current.select(
        F.col("employee_id").alias("now_id"),
        (F.col("text_hash") if detect_changes else none).alias("now_hash"),
        (F.col("fingerprint") if detect_changes else none).alias("now_print"),
    )
    known = registry.drop("action").withColumn("registered", F.lit(True))
    both = now.join(known, F.col("now_id") == F.col("employee_id"), "full_outer")
    present, registered, active = F.col("now_id").isNotNull(), F.col("registered").isNotNull(), F.col("is_active")
    changed = F.col("now_hash").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("now_hash"))
    action = (
        F.when(present & ~registered, F.lit("NEW"))
        .when(present & changed, F.lit("CHANGE"))
        .when(present & active, F.lit("KEEP"))
        .when(present, F.lit("REACTIVATE"))
        .when(active, F.lit("DELETE"))
        .otherwise(F.lit("ABSENT"))
    )
    return both.select(
        F.coalesce("now_id", "employee_id").alias("employee_id"),
        "vector_id", "vector_version", F.coalesce("replaced", F.lit(False)).alias("replaced"),
        F.coalesce("now_hash", "text_hash").alias("text_hash"),
        F.coalesce("now_print", "fingerprint").alias("fingerprint"),
        "embedded_at",
        F.coalesce(active, F.lit(False)).alias("was_active"),
        action.alias("action"),
    )


def next_registry(labels: DataFrame, model: str, version: int, id_function=vector_id) -> DataFrame:
    """Registry after applying the labels (insert-or-replace by id in one pass)."""
    embed = F.col("action").isin(EMBED_ACTIONS)
    return labels.select(
        "employee_id",
        id_function(F.col("employee_id")).alias("vector_id"),
        F.when(embed, F.lit(version).cast("bigint")).otherwise(F.col("vector_version")).alias("vector_version"),
        (F.col("replaced") | (F.col("action") == "CHANGE")).alias("replaced"),
        "text_hash", "fingerprint",
        F.when(embed, F.current_timestamp()).otherwise(F.col("embedded_at")).alias("embedded_at"),
        F.col("action").isin("NEW", "CHANGE", "KEEP", "REACTIVATE").alias("is_active"),
        "action",
        F.lit(model).alias("model"),
    )


def id_conflicts(registry: DataFrame) -> DataFrame:
    """``vector_id, employees, first_id, last_id`` of every vector id that stands for more than one employee."""
    return (
        registry.groupBy("vector_id")
        .agg(F.count("*").alias("employees"), F.min("employee_id").alias("first_id"), F.max("employee_id").alias("last_id"))
        .where("employees > 1")
    )


def require_unique_ids(registry: DataFrame) -> None:
    """An error that names two employees with one vector id; 60 bits do not rule that out for a billion of them."""
    conflict = id_conflicts(registry).orderBy("vector_id").first()
    if conflict:
        raise ValueError(f"vector id {conflict['vector_id']} stands for both {conflict['first_id']!r} and {conflict['last_id']!r}")


def pair_report(vectors: DataFrame, registry: DataFrame) -> dict[str, int]:
    """How the published vectors (``employee_id, version, vec``) and the registry pair up, from one full outer join.

    ``paired``: active ids with the vector they name; ``ids_without_vector``: active ids without it;
    ``vectors_without_id``: vectors of employees the registry does not know; ``wrong_dim``: paired vectors that are not
    of the most frequent dimension (of equally frequent ones the smallest), which is ``dim``, 0 without any.
    """
    held = vectors.select("employee_id", "version", F.size("vec").alias("dim"))
    known = registry.select("employee_id", "vector_version", "is_active")
    state = (
        F.when(F.col("is_active").isNull(), F.lit("unknown"))
        .when(F.col("version") == F.col("vector_version"), F.when(F.col("is_active"), F.lit("paired")))
    )
    counts = held.join(known, "employee_id", "full_outer").groupBy(state.alias("state"), "dim").count().collect()  # a row per dimension
    paired = {r["dim"]: r["count"] for r in counts if r["state"] == "paired"}
    dim = min(paired, key=lambda d: (-paired[d], d), default=0)
    total = sum(paired.values())
    return {
        "paired": total, "ids_without_vector": registry.where("is_active").count() - total,
        "vectors_without_id": sum(r["count"] for r in counts if r["state"] == "unknown"),
        "wrong_dim": total - paired.get(dim, 0), "dim": dim,
    }


def summarize(labelled: DataFrame) -> DataFrame:
    """One row of counts over a labelled registry."""
    def n(*actions):
        return F.count_if(F.col("action").isin(*actions))

    return labelled.agg(
        n("NEW").alias("new_count"), n("CHANGE").alias("changed_count"),
        n("DELETE").alias("deleted_count"), n("REACTIVATE").alias("reactivated_count"),
        n("NEW", "CHANGE", "KEEP", "REACTIVATE").alias("total_active"),
        (n("DELETE", "REACTIVATE", "CHANGE") > 0).alias("rebuild_indexes_required"),
    )


def only_live(vectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Vectors (``employee_id``, ``version``, ...) of active employees, in the version the registry names.

    A semi join on both keys: whatever else lies in the vector table, left by an unfinished run or replaced,
    drops out. The optimizer broadcasts the registry's two columns where it knows them to be small.
    """
    live = registry.where("is_active").select("employee_id", F.col("vector_version").alias("version"))
    return vectors.join(live, ["employee_id", "version"], "left_semi")


def name_vector_ids(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """``employee_id`` for rows that hold only a ``vector_id``; ids unknown or inactive drop out."""
    return hits.join(registry.where("is_active").select("vector_id", "employee_id"), "vector_id")
