"""Search indexes over stored vectors: create, append, rebuild, drop, list, search.

``exact`` is a catalog row over the vector table, bounded by the vector version it was made from.
``ivf`` stores the vectors by cell (``build=N/part=M/cell=C``) with a small centroid table.
Either way results are cosine similarities, and employees that left are filtered before the search. A changed
employee is found by the vector the index holds until the new one is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import require_dim
from ..operators import ivf
from ..operators.knn import KnnOptions
from ..operators.sync import pair_report
from ..schemas import INDEX_CATALOG
from ..sources.tables import TableStore, folder_name, observed_rows
from .embeddings import published_vectors, read_registry, read_vectors, registry_name
from .match import match

CATALOG = "index_catalog"
INDEX_TYPES = ("exact", "ivf")

# Fixed values of the index defaults.
NLIST = 20
NPROBE = 10

_CELL_ROWS = T.StructType([
    T.StructField("employee_id", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
    T.StructField("version", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("cell", T.IntegerType()),
    T.StructField("cosine", T.DoubleType()),
    T.StructField("norm", T.DoubleType()),
])

_REACH = "cell int, n bigint, cosine double, norm double, part bigint"


def read_catalog(store: TableStore) -> DataFrame:
    catalog = store.read(CATALOG, INDEX_CATALOG)
    return catalog if catalog is not None else store.spark.createDataFrame([], INDEX_CATALOG)


def list_indexes(store: TableStore) -> DataFrame:
    return read_catalog(store).select("index_name").orderBy("index_name")


def index_row(store: TableStore, index_name: str) -> Row:
    row = read_catalog(store).where(F.col("index_name") == index_name).first()
    if row is None:
        raise ValueError(f"index {index_name!r} is not in the catalog")
    return row


def _put(store: TableStore, index_name: str, row: dict | None) -> None:
    """New catalog version: the old rows without ``index_name``, plus ``row``."""
    rows = read_catalog(store).where(F.col("index_name") != index_name)
    if row is not None:
        fresh = store.spark.createDataFrame([row], INDEX_CATALOG)
        if row["created_at"] is None:
            fresh = fresh.withColumn("created_at", F.current_timestamp())
        rows = rows.unionByName(fresh)
    version = store.current(CATALOG) + 1
    store.stage(CATALOG, version, rows.coalesce(1))  # one row per index
    store.publish(CATALOG, version)


def _folder(index_name: str, build: int) -> tuple[str, str, str]:
    return "index", folder_name(index_name), f"build={build}"


def _write_cells(store, index_name: str, build: int, part: int, celled: DataFrame) -> int:
    """Vectors by cell, counted as they are written, and a row per cell of what bounds it. The rebalance hint groups
    rows by cell and splits cells that are too large."""
    folder, seen = store.path(*_folder(index_name, build), "cells", f"part={part}"), Observation("cells")
    (
        celled.select("employee_id", "vec", "version", "cell", "cosine", "norm")
        .hint("rebalance", "cell")
        .observe(seen, F.count("*").alias("rows"))
        .write.mode("overwrite").partitionBy("cell")
        .parquet(folder)
    )
    rows = observed_rows(seen)
    reach = ivf.cell_reach(store.spark.read.schema(_CELL_ROWS).parquet(folder)) if rows else store.spark.createDataFrame([], _REACH).drop("part")
    reach.coalesce(1).write.mode("overwrite").parquet(store.path(*_folder(index_name, build), "reach", f"part={part}"))
    return rows


def _celled(vectors: DataFrame, centroids) -> DataFrame:
    return ivf.assign_cells(vectors.select("employee_id", "vec", "version"), centroids, with_reach=True)


def _cells(store: TableStore, row: Row) -> DataFrame:
    path = store.path(*_folder(row["index_name"], row["build"]), "cells")
    return store.spark.read.schema(_CELL_ROWS).parquet(path).where(F.col("part") < row["parts"])


def index_reach(store: TableStore, row: Row) -> DataFrame:
    """``cell, n, cosine, norm`` per part and cell, as stored when the part was written. Vectors that were replaced or
    left since still count, so the bounds hold."""
    path = store.path(*_folder(row["index_name"], row["build"]), "reach")
    return store.spark.read.schema(_REACH).parquet(path).where(F.col("part") < row["parts"]).drop("part")


def index_centroids(store: TableStore, row: Row):
    path = store.path(*_folder(row["index_name"], row["build"]), "centroids")
    return ivf.read_centroids(store.spark.read.parquet(path))


def create_index(store: TableStore, index_name: str, model: str, index_type: str = "exact", *,
                 nlist: int = NLIST, nprobe: int = NPROBE, seed: int = 7, centroids=None) -> dict:
    """Returns ``index_name``, ``vector_count``, and what did not pair: ``unpaired``, the active employees without a
    stored vector, and ``vectors_without_id``, the vectors of employees that the registry does not know.

    An existing name, an unknown type, missing vectors, fewer vectors than ``nlist`` and vectors of unequal length are
    errors. Where fewer than ``nlist`` vectors differ, there are fewer cells until a rebuild finds more. ``centroids``
    replaces training; a rebuild then takes the stored ones again.
    """
    index_type = "exact" if index_type == "flat" else index_type
    if index_type not in INDEX_TYPES:
        raise ValueError(f"unknown index type {index_type!r}; expected one of {INDEX_TYPES}")
    if not read_catalog(store).where(F.col("index_name") == index_name).isEmpty():
        raise ValueError(f"index {index_name!r} exists already; append to it or rebuild it")
    return _build(store, index_name, model, index_type, nlist, nprobe, None if centroids is not None else seed, centroids)


def _build(store: TableStore, index_name: str, model: str, index_type: str, nlist: int, nprobe: int,
           seed: int | None, centroids) -> dict:
    """Write a new build, then put its catalog row in the place of any older one."""
    held = published_vectors(store, model)
    pairs = pair_report(held, read_registry(store, model)) if held is not None else {"paired": 0}
    if not pairs["paired"]:
        raise ValueError(f"no vectors for model {model!r}; sync embeddings first")
    build = store.current(CATALOG) + 1
    vectors = read_vectors(store, model).withColumn("vec", require_dim(F.col("vec"), pairs["dim"]))
    if index_type == "exact" and pairs["wrong_dim"]:
        raise ValueError(f"vector dimension must be {pairs['dim']}; {pairs['wrong_dim']} vectors have another")
    if index_type == "ivf":
        if centroids is None:
            if pairs["paired"] < nlist:
                raise ValueError(f"{pairs['paired']} vectors cannot train {nlist} cells")
            centroids = ivf.train_centroids(vectors, nlist, seed=seed, at_most=True)
        else:
            nlist = len(centroids)
        ivf.centroid_table(store.spark, centroids).coalesce(1).write.mode("overwrite").parquet(
            store.path(*_folder(index_name, build), "centroids"))
        store.delete_folder(*_folder(index_name, build), "cells")  # of an unfinished build
        store.delete_folder(*_folder(index_name, build), "reach")
        _write_cells(store, index_name, build, 0, _celled(vectors, centroids))
    _put(store, index_name, {
        "index_name": index_name, "index_type": index_type, "model": model, "dim": pairs["dim"],
        "nlist": nlist, "nprobe": nprobe, "vector_count": pairs["paired"], "build": build, "parts": 1,
        "vector_version": store.current(registry_name(model)), "seed": seed, "created_at": None,
    })
    return {"index_name": index_name, "vector_count": pairs["paired"], "unpaired": pairs["ids_without_vector"],
            "vectors_without_id": pairs["vectors_without_id"]}


def missing_vectors(vectors: DataFrame, indexed: DataFrame) -> DataFrame:
    """Live vectors the index does not hold in that version."""
    return vectors.join(indexed.select("employee_id", "version"), ["employee_id", "version"], "left_anti")


def append_index(store: TableStore, index_name: str, rebuild: bool = False) -> dict:
    """Add the vectors an index lacks, under its stored centroids, or rebuild it from its stored parameters.

    ``total`` is what a search can find afterwards. A rebuild leaves the old build in use until the new one is
    complete.
    """
    row = index_row(store, index_name)
    model, version = row["model"], store.current(registry_name(row["model"]))
    if rebuild:
        given = index_centroids(store, row) if row["index_type"] == "ivf" and row["seed"] is None else None
        made = _build(store, index_name, model, row["index_type"], row["nlist"], row["nprobe"], row["seed"], given)
        _delete_build(store, row)
        return {"appended": 0, "total": made["vector_count"]}
    vectors, parts = read_vectors(store, model), row["parts"]
    if row["index_type"] == "exact":
        appended = vectors.where(F.col("version") > row["vector_version"]).count()
    else:
        missing = missing_vectors(vectors, _cells(store, row))
        appended = _write_cells(store, index_name, row["build"], parts, _celled(missing, index_centroids(store, row)))
        parts += 1
    following = {**row.asDict(), "parts": parts, "vector_version": version}
    total = index_vectors(store, Row(**following)).count()
    if appended or version != row["vector_version"]:
        _put(store, index_name, following | {"vector_count": total})
    return {"appended": appended, "total": total}


def compact_index(store: TableStore, index_name: str) -> dict[str, int]:
    """Rewrite the parts of an index as one, without replaced vectors and under the same centroids, then swap its row."""
    row = index_row(store, index_name)
    if row["index_type"] == "exact":
        return {"kept": row["vector_count"], "dropped": 0}  # holds no vectors of its own
    build, before = store.current(CATALOG) + 1, int(index_reach(store, row).agg(F.sum("n")).first()[0] or 0)
    named = read_registry(store, row["model"], version=row["vector_version"]).select("employee_id", F.col("vector_version").alias("version"))
    held = _cells(store, row).join(named, ["employee_id", "version"], "left_semi")
    ivf.centroid_table(store.spark, index_centroids(store, row)).coalesce(1).write.mode("overwrite").parquet(
        store.path(*_folder(index_name, build), "centroids"))
    store.delete_folder(*_folder(index_name, build), "cells")
    store.delete_folder(*_folder(index_name, build), "reach")
    kept = _write_cells(store, index_name, build, 0, held)
    _put(store, index_name, row.asDict() | {"build": build, "parts": 1})
    _delete_build(store, row)
    return {"kept": kept, "dropped": before - kept}


def _delete_build(store: TableStore, row: Row) -> None:
    if row["index_type"] == "ivf":
        store.delete_folder(*_folder(row["index_name"], row["build"]))


def drop_index(store: TableStore, index_name: str) -> None:
    row = index_row(store, index_name)
    _put(store, index_name, None)
    _delete_build(store, row)


def index_vectors(store: TableStore, row: Row) -> DataFrame:
    """What an index finds: ``employee_id, vec`` (+ ``cell``) of employees active now, each by the vector that the
    registry named when the index was made or last appended to."""
    held = published_vectors(store, row["model"]) if row["index_type"] == "exact" else _cells(store, row)
    then = read_registry(store, row["model"], version=row["vector_version"]).select(
        "employee_id", F.col("vector_version").alias("version"))
    now = read_registry(store, row["model"], active_only=True).select("employee_id")
    return held.join(then.join(now, "employee_id", "left_semi"), ["employee_id", "version"], "left_semi")


def search_index(store: TableStore, index_name: str, requirements: DataFrame, profiles: DataFrame, *,
                 model: str, nprobe: int | None = None, exact: bool = False, options: KnnOptions = KnnOptions(),
                 **match_arguments) -> DataFrame:
    """``match`` against a stored index. ``model`` is what the requirement vectors come from; another model or
    dimension than the index's is an error. ``nprobe`` overrides the stored one; ``exact`` searches cells after these
    as long as their stored bounds can still hold a candidate."""
    row = index_row(store, index_name)
    if model != row["model"]:
        raise ValueError(f"index {index_name!r} holds vectors of {row['model']!r}, not of {model!r}")
    checked = requirements.withColumn("vec", require_dim(F.col("vec"), row["dim"]))
    if row["index_type"] == "ivf":
        centroids, reach = index_centroids(store, row), index_reach(store, row)
        match_arguments |= {"centroids": centroids, "nprobe": row["nprobe"] if nprobe is None else nprobe,
                            "cell_sizes": reach.select("cell", "n")}
        if exact:
            match_arguments["reach"] = ivf.read_reach(reach, len(centroids))
    return match(checked, profiles, index_vectors(store, row), options=options,
                 vector_count=row["vector_count"], **match_arguments)
