"""Keep the stored vectors of a model in step with the employee table."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vectors import vector_id
from ..operators.encode import encode_profiles
from ..operators.profiles import build_profiles, profile_fingerprints
from ..operators.sync import EMBED_ACTIONS, label_ids, next_registry, only_live, require_unique_ids, summarize, unsure_ids
from ..schemas import BASE_VECTORS, EMBEDDING, INDEX_CATALOG, REGISTRY
from ..sources.tables import TableStore, folder_name, observed_rows, read_or_none, work_folder


@dataclass(frozen=True)
class SyncResult:
    version: int
    new_count: int
    changed_count: int
    deleted_count: int
    reactivated_count: int
    total_active: int
    rebuild_indexes_required: bool


def registry_name(model: str) -> str:
    return f"registry/{folder_name(model)}"


def _vector_folder(model: str, version: int) -> tuple[str, str, str]:
    return "vectors", f"model={folder_name(model)}", f"version={version}"


def read_registry(store: TableStore, model: str, active_only: bool = False, version: int | None = None) -> DataFrame:
    """The published registry, or an earlier version of it."""
    registry = store.read(registry_name(model), REGISTRY, version)
    if registry is None:
        registry = store.spark.createDataFrame([], REGISTRY)
    return registry.where("is_active") if active_only else registry


def base_name(model: str) -> str:
    """Compacted vectors; their version is the registry version up to which they replace the folders of the runs."""
    return f"vectors_base/{folder_name(model)}"


def _current_texts(store: TableStore, employees: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``employee_id, fingerprint, text_hash`` of the snapshot, and ``employee_id, profile_text`` as a written table; texts
    are built, once, only where the fingerprint is not the registered one."""
    folder = work_folder(store.spark)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return store.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    prints = kept(profile_fingerprints(employees), "prints")
    unsure = kept(unsure_ids(prints, registry), "unsure")
    if unsure.isEmpty():
        return prints.withColumn("text_hash", F.lit(None).cast("string")), None
    texts = kept(build_profiles(employees, only=unsure).select(
        "employee_id", F.sha2("profile_text", 256).alias("text_hash"), "profile_text"), "texts")
    return prints.join(texts.select("employee_id", "text_hash"), "employee_id", "left"), texts.select("employee_id", "profile_text")


def sync_embeddings(store: TableStore, employees: DataFrame, encoder, *, detect_changes: bool = False,
                    id_function=vector_id) -> SyncResult:
    """Label all ids, encode only what is new (or changed), then publish.

    Order: labels counted, and nothing written if nothing changed; registry version written but not visible and its
    ids checked to be unique, vectors written and counted, version published. Vectors that an unfinished run left under
    the same version are removed even if this run embeds nothing.
    """
    model, name = encoder.model, registry_name(encoder.model)
    before = store.current(name)
    version = before + 1
    registry = read_registry(store, model)
    current, texts = _current_texts(store, employees, registry) if detect_changes else (employees.select("employee_id").distinct(), None)
    labels = label_ids(current, registry, detect_changes)
    following = next_registry(labels, model, version, id_function).persist()
    counts = summarize(following).first().asDict()
    touched = sum(counts[c] for c in ("new_count", "changed_count", "deleted_count", "reactivated_count"))
    if touched == 0:
        following.unpersist()
        return SyncResult(version=before, **counts)
    staged = store.stage(name, version, following)
    following.unpersist()
    if counts["new_count"]:
        require_unique_ids(staged)
    to_embed = counts["new_count"] + counts["changed_count"]
    if to_embed:
        wanted = staged.where(F.col("action").isin(EMBED_ACTIONS)).select("employee_id") if to_embed < counts["total_active"] else None
        if texts is None:
            profiles = build_profiles(employees, only=wanted)
        else:  # whoever is new or changed has a text there
            profiles = texts if wanted is None else texts.join(wanted, "employee_id", "left_semi")
        vectors = encode_profiles(profiles, encoder).select(
            "employee_id", id_function(F.col("employee_id")).alias("vector_id"), "vec"
        )
        seen = Observation("vectors")
        vectors.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(store.path(*_vector_folder(model, version)))
        if observed_rows(seen) != to_embed:
            raise ValueError(f"the encoder gave {observed_rows(seen)} vectors for {to_embed} employees")
    else:
        store.delete_folder(*_vector_folder(model, version))
    store.publish(name, version)
    return SyncResult(version=version, **counts)


def published_vectors(store: TableStore, model: str) -> DataFrame | None:
    """Every published vector of a model, replaced ones included as far as they are kept; None without any.

    The compacted table, and the runs after it (partition pruned).
    """
    version, base = store.current(registry_name(model)), store.current(base_name(model))
    if version == 0:
        return None
    rows = read_or_none(store.spark, store.path("vectors"), EMBEDDING)
    if rows is not None:
        rows = rows.where((F.col("model") == model) & (F.col("version") > base) & (F.col("version") <= version))
    if not base:
        return rows
    compacted = store.read(base_name(model), BASE_VECTORS, base).withColumn("model", F.lit(model)).select(*EMBEDDING.fieldNames())
    return compacted if rows is None else compacted.unionByName(rows)


def compact_vectors(store: TableStore, model: str) -> dict[str, int]:
    """Rewrite the vectors that something still names into one table, then swap one log row.

    Named are those of the current registry, inactive employees included, and of the registry versions that indexes
    serve. What a lost run leaves is not read, and the next one overwrites it. ``delete_compacted`` frees the space.
    """
    version, base = store.current(registry_name(model)), store.current(base_name(model))
    if version == 0:
        raise ValueError(f"no vectors for model {model!r}; sync embeddings first")
    if version == base:
        return {"version": base, "kept": 0, "dropped": 0}
    catalog = store.read("index_catalog", INDEX_CATALOG)
    served = [] if catalog is None else [r[0] for r in catalog.where(F.col("model") == model).select("vector_version").distinct().collect()]
    named = None
    for v in sorted({version, *served}):  # a version per index at the most
        part = read_registry(store, model, version=v).select("employee_id", F.col("vector_version").alias("version"))
        named = part if named is None else named.unionByName(part)
    vectors = published_vectors(store, model)
    read, kept = Observation("read"), Observation("kept")
    rows = (vectors.observe(read, F.count("*").alias("rows")).join(named.distinct(), ["employee_id", "version"], "left_semi")
            .select(*BASE_VECTORS.fieldNames()).observe(kept, F.count("*").alias("rows")))
    store.stage(base_name(model), version, rows)
    store.publish(base_name(model), version)
    return {"version": version, "kept": observed_rows(kept), "dropped": observed_rows(read) - observed_rows(kept)}


def delete_compacted(store: TableStore, model: str, retention_hours: float = 24.0) -> int:
    """Remove folders that a compaction replaced at least so long ago, when no reader can be in them; returns how many."""
    old = store.published().where(
        (F.col("name") == base_name(model)) & (F.expr("current_timestamp()") - F.expr(f"INTERVAL '{int(retention_hours * 3600)}' SECOND") >= F.col("published_at")))
    limit = old.agg(F.max("version")).first()[0] or 0
    runs, bases, removed = ("vectors", f"model={folder_name(model)}"), (base_name(model),), 0
    for parts, below in ((runs, limit + 1), (bases, limit)):
        for folder in store.folders(*parts):
            if folder.startswith("version=") and int(folder.split("=")[1]) < below:
                store.delete_folder(*parts, folder)
                removed += 1
    return removed


def read_vectors(store: TableStore, model: str, live_only: bool = True) -> DataFrame | None:
    """Published vectors of a model, only live ones by default; None without any."""
    rows = published_vectors(store, model)
    return only_live(rows, read_registry(store, model)) if rows is not None and live_only else rows


def embedding_sets(store: TableStore) -> DataFrame:
    """``model, vector_count, dim`` of every published set, sorted by model."""
    names = [r["name"] for r in store.log().where("name LIKE 'registry/%' AND version > 0").collect()]  # a row per model
    sets = store.spark.createDataFrame([], "model string, vector_count bigint, dim int")
    for model in (unquote(n.removeprefix("registry/")) for n in names):
        rows = published_vectors(store, model)
        if rows is not None:
            sets = sets.unionByName(rows.groupBy("model").agg(F.count("*").alias("vector_count"), F.max(F.size("vec")).alias("dim")))
    return sets.orderBy("model")
