"""Inverted-file cells: train centroids, assign vectors, choose the cells to probe."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import work_folder
from .knn import _PRODUCT_VALUES, _matrix

# Centroids pass through the driver and are broadcast: their bytes are checked.
MAX_CENTROID_BYTES = 512 * 1024 * 1024
# Room for rounding in the bound of a cell, far above the error of its double arithmetic.
_BOUND_SLACK = 1e-7

_SUMS = ("cell int, n bigint, kinds bigint, sums array<bigint>, far_similarity double, far_id string, far array<double>")


def check_centroid_bytes(cells: int, dim: int) -> None:
    if cells * dim * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{cells} centroids of {dim} values exceed {MAX_CENTROID_BYTES} bytes; use fewer cells")


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _cell_sums(shared, scale: float):
    """Per cell of a task: rows, distinct vectors, whole-number sums, and the vector least similar to the centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        cells, dim = centroids.shape
        turned = np.ascontiguousarray(centroids.T)
        n, kinds, sums = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros((cells, dim), np.int64)
        far_similarity, far_id, far = np.full(cells, np.inf), np.full(cells, None, object), np.zeros((cells, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, weight = _matrix(batch.column("vec"), dim), batch.column("n").to_numpy()
            cell, similarity = _nearest_one(matrix, turned)
            names = np.array(batch.column("first_id").to_pylist(), dtype=object)
            order = np.lexsort((names, similarity, cell))
            here, starts = np.unique(cell[order], return_index=True)
            whole = np.floor(matrix * scale + 0.5).astype(np.int64) * weight[:, None]
            sums[here] += np.add.reduceat(whole[order], starts, axis=0)
            n[here] += np.add.reduceat(weight[order], starts)
            kinds[here] += np.diff([*starts, len(order)])
            for c, row in zip(here, order[starts]):
                if far_id[c] is None or (similarity[row], names[row]) < (far_similarity[c], far_id[c]):
                    far_similarity[c], far_id[c], far[c] = similarity[row], names[row], matrix[row]
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(kinds[some]), _lists(sums[some]),
                 pa.array(far_similarity[some]), pa.array(far_id[some], pa.string()), _lists(far[some])],
                names=["cell", "n", "kinds", "sums", "far_similarity", "far_id", "far"])

    return run


def _merge_sums(table: pa.Table) -> pa.Table:
    """The sums of one cell over all tasks: a row per task at the most."""
    similarity, names = table.column("far_similarity").to_pylist(), table.column("far_id").to_pylist()
    least = min(range(len(names)), key=lambda i: (similarity[i], names[i]))
    sums = table.column("sums").combine_chunks()
    width = len(sums[0])
    total = sums.flatten().to_numpy().reshape(-1, width).sum(axis=0)
    one = table.slice(least, 1)
    for name, values in (("n", pa.array([sum(table.column("n").to_pylist())])),
                         ("kinds", pa.array([sum(table.column("kinds").to_pylist())])), ("sums", _lists(total[None, :]))):
        one = one.set_column(one.schema.get_field_index(name), name, values)
    return one


def group_copies(vectors: DataFrame, key: str = "employee_id") -> DataFrame:
    """``vec, n, first_id`` of the distinct non-zero vectors.

    The least id is a text, so the aggregate sorts. A hash of the vector comes first among its keys: whole numbers sort many
    times faster than arrays, which are then compared only where the hashes agree.
    """
    return (
        vectors.where(F.exists("vec", lambda x: x != 0)).groupBy(F.xxhash64("vec").alias("_hash"), "vec")
        .agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("first_id")).drop("_hash")
    )


def distinct_vectors(vectors: DataFrame, key: str = "employee_id") -> DataFrame:
    """``group_copies`` as a written table."""
    found = group_copies(vectors, key)
    folder = f"{work_folder(vectors.sparkSession)}/distinct"
    found.write.parquet(folder)
    return vectors.sparkSession.read.schema(found.schema).parquet(folder)


def train_centroids(vectors: DataFrame, nlist: int, *, seed: int = 7, max_iter: int = 20, key: str = "employee_id",
                    at_most: bool = False) -> np.ndarray:
    """``nlist`` unit centroids by weighted k-means over the distinct vectors, every one of them with a non-empty cell.

    Seeds are the vectors with the smallest hashes of ``seed`` and their first id. A round is one pass: tasks add up
    whole numbers on a fixed grid, so centroids do not depend on partitioning. A cell left empty takes over the vector
    that the heaviest cells hold worst. After ``max_iter`` rounds, or when no centroid moves, cells that are still empty
    are filled in the same way with all other centroids kept; each such step raises the total similarity, so it ends.
    Zero vectors take no part. Fewer distinct directions than cells are an error, or with ``at_most`` make fewer cells.
    """
    if nlist < 1:
        raise ValueError(f"nlist must be at least 1, got {nlist}")
    spark, distinct = vectors.sparkSession, distinct_vectors(vectors, key)
    size = distinct.agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.size("vec")).alias("dim"),
                        F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    if at_most:
        nlist = min(nlist, size["kinds"])
    if size["kinds"] < max(nlist, 1):
        raise ValueError(f"{size['kinds']} distinct vectors cannot train {nlist} cells")
    check_centroid_bytes(nlist, size["dim"])
    bits = min(40, 62 - math.ceil(math.log2(size["n"] * float(size["most"]) + 1)))  # sums stay within 64 bits
    place = F.sha2(F.concat_ws(":", F.lit(str(seed)), "first_id"), 256)
    seeds = distinct.orderBy(place, "first_id").limit(nlist).select("vec").toArrow()
    centroids = _unit(_matrix(seeds.column("vec"), size["dim"]))
    for step in count():
        shared = spark.sparkContext.broadcast(centroids)
        stats = (distinct.mapInArrow(_cell_sums(shared, 2.0 ** bits), _SUMS)
                 .groupBy("cell").applyInArrow(_merge_sums, _SUMS).toArrow())  # a row per cell
        shared.unpersist()
        cells, n, far_similarity = (stats.column(c).to_numpy() for c in ("cell", "n", "far_similarity"))
        empty, last = np.setdiff1d(np.arange(nlist), cells), step >= max_iter
        following = centroids.copy()
        if not last:
            means = _unit(_matrix(stats.column("sums"), size["dim"]))
            moved = (means != 0).any(axis=1)  # opposite vectors may cancel out
            following[cells[moved]] = means[moved]
        if not len(empty) and (last or (following == centroids).all()):
            return centroids
        if len(empty):
            donors = np.lexsort((cells, -n))
            donors = donors[far_similarity[donors] < 1][:len(empty)]
            if not len(donors) and at_most:
                return centroids[np.sort(cells)]
            if not len(donors):
                raise ValueError(f"{len(cells)} distinct vectors cannot train {nlist} cells: the others are too close to them")
            following[empty[:len(donors)]] = _unit(_matrix(stats.column("far"), size["dim"])[donors])
        centroids = following


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "cell": pa.array(np.arange(len(centroids), dtype=np.int32)), "centroid": _lists(np.asarray(centroids, dtype=np.float64))}))


def read_centroids(table: DataFrame) -> np.ndarray:
    """The centroid matrix; its bytes are checked before it reaches the driver."""
    size = table.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    check_centroid_bytes(size["n"], size["dim"] or 0)
    rows = table.select("cell", "centroid").toArrow().sort_by("cell")
    if rows.column("cell").to_pylist() != list(range(size["n"])):
        raise ValueError("centroid cells must be numbered 0..n-1")
    return _matrix(rows.column("centroid"), size["dim"])


def _nearest(vectors: np.ndarray, turned: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` most similar centroids, best first, lower cell first on equal values."""
    out = np.empty((len(vectors), count), dtype=np.int32)
    step = max(1, _PRODUCT_VALUES // turned.shape[1])
    for start in range(0, len(vectors), step):
        sims = np.floor((vectors[start:start + step] @ turned) * 1e9 + 0.5) / 1e9
        if count == 1:
            out[start:start + step, 0] = sims.argmax(axis=1)
        else:
            out[start:start + step] = np.argsort(-sims, axis=1, kind="stable")[:, :count]
    return out


def _nearest_one(vectors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most similar centroid per row and the similarity, on the grid that decides."""
    cell, similarity = np.empty(len(vectors), dtype=np.int32), np.empty(len(vectors))
    step = max(1, _PRODUCT_VALUES // turned.shape[1])
    for start in range(0, len(vectors), step):
        sims = np.floor((vectors[start:start + step] @ turned) * 1e9 + 0.5) / 1e9
        cell[start:start + step] = best = sims.argmax(axis=1)
        similarity[start:start + step] = np.take_along_axis(sims, best[:, None], axis=1)[:, 0]
    return cell, similarity


def assign_cells(vectors: DataFrame, centroids: np.ndarray, with_reach: bool = False) -> DataFrame:
    """Adds ``cell``, the most similar centroid; ``with_reach`` also ``cosine`` to it and ``norm``. Narrow: no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centroids.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = shared.value
        for batch in batches:
            matrix = _matrix(batch.column("vec"), turned.shape[0])
            cell, similarity = _nearest_one(matrix, turned)
            out = batch.append_column("cell", pa.array(cell, type=pa.int32()))
            if with_reach:
                norm = np.sqrt((matrix * matrix).sum(axis=1))
                cosine = np.divide(similarity, norm, out=np.ones_like(norm), where=norm > 0)
                out = out.append_column("cosine", pa.array(cosine)).append_column("norm", pa.array(norm))
            yield out

    more = [T.StructField("cell", T.IntegerType())]
    if with_reach:
        more += [T.StructField("cosine", T.DoubleType()), T.StructField("norm", T.DoubleType())]
    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, *more]))


def cell_reach(celled: DataFrame) -> DataFrame:
    """``cell, n, cosine, norm``: rows, smallest cosine to the centroid and largest norm per cell, from ``assign_cells`` with reach."""
    return celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine"), F.max("norm").alias("norm"))


def read_reach(reach: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, widest angle and largest norm by cell; cells without rows have none. One row per cell passes the driver."""
    n, angle, norm = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
    merged = reach.groupBy("cell").agg(F.sum("n").alias("n"), F.min("cosine").alias("cosine"), F.max("norm").alias("norm")).toArrow()
    at = merged.column("cell").to_numpy()
    n[at], norm[at] = merged.column("n").to_numpy(), merged.column("norm").to_numpy()
    angle[at] = np.arccos(np.clip(merged.column("cosine").to_numpy() - _BOUND_SLACK, -1, 1))
    return n, angle, norm


def cells_within(probes: DataFrame, centroids: np.ndarray, reach: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``requirement_id, vec, floor, cells``: the cells outside ``cells`` that may hold a similarity of ``floor`` or more.

    For a vector v of cell c the angles obey (q, v) >= (q, c) - (c, v), and (c, v) is at most the cell's widest angle;
    so no vector of the cell has more than |q| |v| cos(max(0, (q, c) - widest)).
    """
    n, widest, norm = reach
    shared = probes.sparkSession.sparkContext.broadcast((np.ascontiguousarray(centroids.T), n > 0, widest, norm))
    rows = probes.select("requirement_id", "vec", "floor", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, filled, widest, norm = shared.value
        for batch in batches:
            matrix = _matrix(batch.column("vec"), turned.shape[0])
            lists, floor = batch.column("cells"), batch.column("floor").to_numpy()
            size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            wanted = np.zeros((len(matrix), turned.shape[1]), dtype=bool)
            step = max(1, _PRODUCT_VALUES // turned.shape[1])
            for start in range(0, len(matrix), step):
                part = slice(start, start + step)
                cosine = np.divide(matrix[part] @ turned, size[part], out=np.ones((len(matrix[part]), turned.shape[1])), where=size[part] > 0)
                gap = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - widest, 0)
                most = size[part] * norm * np.maximum(np.cos(gap), 0) + _BOUND_SLACK
                wanted[part] = filled & (most >= floor[part, None])
            wanted[np.repeat(np.arange(len(matrix)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = False
            row, cell = np.nonzero(wanted)
            offsets = np.searchsorted(row, np.arange(len(matrix) + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
            yield batch.set_column(batch.schema.get_field_index("cells"), "cells", found)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def probed_share(probes: DataFrame, reach: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``requirement_id, n_cells, n_vectors, share`` of the stored vectors that the probed ``cells`` hold."""
    counts = F.array(*[F.lit(int(x)) for x in reach[0]])
    total = max(int(reach[0].sum()), 1)
    seen = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.get(counts, c))
    return probes.select("requirement_id", F.size("cells").alias("n_cells"), seen.alias("n_vectors"), (seen / F.lit(total)).alias("share"))


def probe_cells(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """Adds ``cells``, the ``nprobe`` most similar cells (all cells when ``nprobe`` is larger)."""
    if nprobe < 1:
        raise ValueError(f"nprobe must be at least 1, got {nprobe}")
    count = min(nprobe, len(centroids))
    shared = queries.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centroids.T))
    rows = queries.select("requirement_id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = shared.value
        for batch in batches:
            matrix = _matrix(batch.column("vec"), turned.shape[0])
            cells = _nearest(matrix, turned, count) if len(matrix) else np.zeros((0, count), np.int32)
            offsets = np.arange(0, (len(matrix) + 1) * count, count, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))
            yield batch.append_column("cells", lists)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
