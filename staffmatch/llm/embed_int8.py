"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Every unit vector v is quantised to q * s with integers |q| <= 127; e = |v - q s| is known exactly, so for two
vectors |v.w - (q.p) s t| <= e |w| + f |p t| <= e + f (1 + e) + rounding. Tiles of integer products (exact in float32
for up to 1000 dimensions, cut into such parts beyond) give for every pair an upper bound of its cosine; only pairs
whose bound reaches the threshold are computed again from the original vectors in double precision.

Equal vectors are one class with a count, so copies of any number cost one row. Classes are dealt to blocks of bounded
size, and each pair of blocks is one task's work; a task gives out a row per linked class (its number of links) and
the edges of a spanning forest, never a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.bktree import merge_labels
from staffmatch.llm.components import connected_components
from staffmatch.llm.scratch import Scratch

THRESHOLD = 0.9
#: Classes per block: two blocks and their products are what a task holds.
BLOCK_ROWS = 8192
TILE_ROWS = 1024
#: Covers the rounding of all float64 steps of a bound; far above it, far below any real gap.
ROUNDING = 1e-9
#: Dimensions whose int8 products add up exactly in float32: 127 * 127 * EXACT_DIMS < 2^24.
EXACT_DIMS = 1000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (as float32), scale and error norm per row of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    ints = np.rint(unit / scale[:, None])
    return ints.astype(np.float32), scale, np.linalg.norm(unit - ints * scale[:, None], axis=1)


class Block:
    """The classes of one block in double precision and quantised."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        _, power = np.frexp(np.abs(vectors).max(axis=1))
        self.ids, self.weights, self.vectors = ids, weights, np.ldexp(vectors, -power[:, None])  # same direction, safe squares
        vectors = self.vectors
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.ints, self.scale, self.error = quantise(vectors / self.norms[:, None])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    parts = [a[:, i:i + EXACT_DIMS] @ b[:, i:i + EXACT_DIMS].T for i in range(0, a.shape[1], EXACT_DIMS)]
    return np.sum(parts, axis=0, dtype=np.float64)


def links(a: Block, b: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of row numbers of both blocks, tile by tile; each pair once if the blocks are the same."""
    for i in range(0, len(a.ids), TILE_ROWS):
        rows = slice(i, i + TILE_ROWS)
        for j in range(i if same else 0, len(b.ids), TILE_ROWS):
            cols = slice(j, j + TILE_ROWS)
            product = _products(a.ints[rows], b.ints[cols])
            # A pair may link only if product * s * t + bound >= THRESHOLD. Compared in float32 with a margin first.
            e, f = a.error[rows], b.error[cols]
            slack = e.max() + f.max() * (1 + e.max()) + ROUNDING
            scaled = product * (a.scale[rows, None] * b.scale[cols]).astype(np.float32)
            x, y = np.nonzero(scaled >= np.float32(THRESHOLD - slack - 1e-5))
            exact = product[x, y].astype(np.float64) * a.scale[rows][x] * b.scale[cols][y]
            near = exact + e[x] + f[y] * (1 + e[x]) + ROUNDING >= THRESHOLD
            x, y = x[near] + i, y[near] + j
            if same:
                x, y = x[x < y], y[x < y]
            linked = np.zeros(len(x), dtype=bool)
            for low in range(0, len(x), 65_536):
                p, q = x[low:low + 65_536], y[low:low + 65_536]
                dots = np.einsum("ij,ij->i", a.vectors[p], b.vectors[q])
                linked[low:low + 65_536] = dots / (a.norms[p] * b.norms[q]) >= THRESHOLD
            if linked.any():
                yield x[linked], y[linked]


def _block(batch: pa.RecordBatch | pa.Table, side: np.ndarray) -> Block:
    vectors = batch.column("embedding").combine_chunks() if isinstance(batch, pa.Table) else batch.column("embedding")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    pick = lambda c: batch.column(c).to_numpy()[side]
    return Block(pick("class_id"), pick("n"), flat.reshape(len(side), -1)[side])


def _pair_of_blocks(table: pa.Table) -> pa.Table:
    first = table.column("first").to_numpy(zero_copy_only=False)
    low, high = int(table.column("a")[0].as_py()), int(table.column("b")[0].as_py())
    a = _block(table, first)
    b = a if low == high else _block(table, ~first)
    ids = a.ids if low == high else np.concatenate([a.ids, b.ids])
    weights = a.weights if low == high else np.concatenate([a.weights, b.weights])
    shift = 0 if low == high else len(a.ids)
    count, labels = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for x, y in links(a, b, low == high):
        y = y + shift
        np.add.at(count, x, weights[y])
        np.add.at(count, y, weights[x])
        labels = merge_labels(labels, x, y)
    some = np.flatnonzero(count)
    return pa.table({"class_id": pa.array(ids[some]), "links": pa.array(count[some]), "other": pa.array(ids[labels[some]])})


def near_vectors(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding; other columns are ignored).

    A vector that is null, zero, empty, or holds null or non-finite components links with nothing: no links, its own
    id as component. Vectors of different lengths never link. Repeated rows come out once each and count as vectors
    of their own. A null id gets the component of its vector's class and is never kept.
    """
    scratch = Scratch(vectors.sparkSession, "int8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.expr("""embedding IS NOT NULL AND size(embedding) > 0
        AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))
        AND exists(embedding, x -> x <> 0)""")
    valid = rows.where(F.coalesce(usable, F.lit(False))).withColumn("key", F.sha2(F.to_json("embedding"), 256))
    # Classes of equal vectors; their smallest id names them.
    classes = scratch.store(
        valid.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
        .withColumn("class_id", F.monotonically_increasing_id()), "classes")  # fixed by the written table
    sizes = classes.groupBy(F.size("embedding").alias("dim")).count().collect()  # a row per vector length
    pairs = None
    for dim, n in ((r["dim"], r["count"]) for r in sizes):
        blocks = math.ceil(n / block_rows)
        dealt = (classes.where(F.size("embedding") == dim).select("class_id", "n", "embedding")
                 .withColumn("block", F.pmod(F.xxhash64("class_id"), F.lit(blocks))))
        meetings = dealt.select("class_id", "n", "embedding", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
        part = meetings.select(F.lit(dim).alias("dim"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
                               (F.col("block") <= F.col("other")).alias("first"), "class_id", "n", "embedding")
        pairs = part if pairs is None else pairs.unionByName(part)
    ids = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.to_json("embedding"), 256)))
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = scratch.store(pairs.groupBy("dim", "a", "b").applyInArrow(
        _pair_of_blocks, "class_id long, links long, other long"), "links")
    nodes = connected_components(found.select(F.col("class_id").alias("a"), F.col("other").alias("b")), scratch)
    totals = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    labelled = (classes.select("key", "class_id", "first_id", "n").join(totals, "class_id", "left")
                .join(nodes.withColumnRenamed("node", "class_id"), "class_id", "left")
                .withColumn("component", F.coalesce("component", "class_id")))
    heads = labelled.groupBy("component").agg(F.min("first_id").alias("head"))
    named = scratch.store(labelled.join(heads, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "head"), "named")
    return ids.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("head", "vec_id"), F.lit(False)).alias("kept"))
