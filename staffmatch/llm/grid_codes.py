"""Vector code compression: product codebooks trained and applied in exact integers through memoised grid cells.

A component x becomes floor(SCALE * x). Vectors are cut into PARTS equal parts; each part position has a codebook of at
most ENTRIES entries, which starts as that part of the vectors with the smallest ids and is refined ROUNDS times.

To find a part's nearest entry, its coarse grid cell is hashed. A cell that is met first is a box, for which every
entry has a least and a greatest distance; an entry whose least distance exceeds the smallest greatest distance is
dominated: no point of the box is nearest to it. The entries left are remembered per cell, and only they are evaluated
exactly. Remembered cells are bounded per task and simply computed again after that.

A round is one pass over the stored integers: tasks give out a sum and a count per entry and component, Spark adds
them, and the codebooks (ENTRIES x dimension integers) are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.scratch import Scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Side of a grid cell is 2^CELL_BITS.
CELL_BITS = 8
#: Cells remembered per part position in a task.
MEMO_CELLS = 1 << 16
#: Vectors worked on at a time.
STEP_ROWS = 4096
#: Label totals up to so many bytes are broadcast; beyond it the join is salted.
BROADCAST_BYTES = 16 << 20
SALTS = 32


def box_candidates(cells: np.ndarray, book: np.ndarray, bits: int) -> np.ndarray:
    """Per cell and entry of `book`: whether the entry is not dominated across the cell's box."""
    least, most = (np.zeros((len(cells), len(book)), dtype=np.int64) for _ in range(2))
    for low, middle in zip((cells << bits).T[:, :, None], book.T):
        below = low - middle
        above = -below - (1 << bits) + 1
        gap = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(-below, -above)  # the farther end of the side
        least += gap * gap
        most += reach * reach
    return least <= most.min(axis=1, keepdims=True)


class Nearest:
    """Nearest entries of one part position, with the candidates of every cell seen."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS, memo_cells: int = MEMO_CELLS) -> None:
        self.book, self.bits, self.memo_cells = book, bits, memo_cells
        self.memo: dict[bytes, bytes] = {}
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        names = [c.tobytes() for c in cells]
        fresh = np.array([i for i, name in enumerate(names) if name not in self.memo], dtype=np.int64)
        if len(self.memo) + len(fresh) > self.memo_cells:
            self.memo.clear()
            fresh = np.arange(len(names))
        for i, mask in zip(fresh, box_candidates(cells[fresh], self.book, self.bits)):
            self.memo[names[i]] = mask.tobytes()
        return np.frombuffer(b"".join([self.memo[name] for name in names]), dtype=bool).reshape(len(names), len(self.book))

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (ties to the lower index) and squared distance per row of `values`."""
        grid = np.ascontiguousarray(values >> self.bits)
        if not grid.shape[1]:
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
        _, first, at = np.unique(grid.view(f"V{8 * grid.shape[1]}").ravel(), return_index=True, return_inverse=True)
        rows, entry = np.nonzero(self._candidates(grid[first])[at])
        self.evaluated += len(rows)
        gap = values[rows] - self.book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(rows, np.arange(len(values)))
        best = np.minimum.reduceat(distance, starts) if len(values) else distance
        hits = np.flatnonzero(distance == best[rows])
        _, lowest = np.unique(rows[hits], return_index=True)
        return entry[hits[lowest]], best


def _steps(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Slices of the batches with their parts (PARTS, rows, width) and the nearest entries of each."""
    nearest = [Nearest(book) for book in books]
    for batch in batches:
        for start in range(0, len(batch), STEP_ROWS):
            piece = batch.slice(start, STEP_ROWS)
            flat = piece.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts = np.ascontiguousarray(flat.reshape(len(piece), len(books), -1).transpose(1, 0, 2))
            yield piece, parts, [find(part) for find, part in zip(nearest, parts)]


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for _, parts, found in _steps(batches, books):
            for number, (entry, _) in enumerate(found):
                np.add.at(totals[number], entry, parts[number])
                counts[number] += np.bincount(entry, minlength=books.shape[1])
        part, entry, place = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, totals.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)),
             pa.array(counts[part, entry]), pa.array(totals[part, entry, place])], ["part", "entry", "place", "n", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, found in _steps(batches, books):
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex().encode()
            width = 2 * len(books)
            offsets = np.arange(0, width * len(piece) + 1, width, dtype=np.int32)
            code = pa.Array.from_buffers(pa.string(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(digits)])
            error = np.sum([distance for _, distance in found], axis=0)
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), code, pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, ints) of the vectors that are coded."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    # The greatest error that may come up is 4 * dim * limit^2, which has to stay below 2^63.
    limit = f"{2.0 ** 30} / sqrt(size(e)) / {SCALE}"
    fit = F.expr(f"e IS NOT NULL AND size(e) % {PARTS} = 0 AND forall(e, x -> x IS NOT NULL AND abs(x) <= {limit})")
    rows = rows.where(F.coalesce(fit, F.lit(False)))
    lengths = rows.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    dim = lengths[0]["dim"] if lengths else 0
    return rows.where(F.size("e") == dim).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("ints"))


def train(stored: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (PARTS, entries, width) from a stored table of (vec_id, ints); None if it has no rows."""
    heads = stored.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    if not heads:
        return None
    books = np.array([r["ints"] for r in heads], dtype=np.int64).reshape(len(heads), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = (stored.select("ints").mapInArrow(_sums(books), "part int, entry int, place int, n long, total long")
                .groupBy("part", "entry", "place")
                .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
        books = books.copy()
        for r in sums:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per vector that is coded, from (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are dropped; so are those whose length is not the most
    frequent one that PARTS divides (of equally frequent ones the shortest), and those with a component so large that
    errors could leave 64 bits (beyond 2^30 / sqrt(length) after scaling). Rows with the same id are vectors of their own; null ids come last in the order
    of ids, and equal ids go by their components. Fewer than ENTRIES vectors make smaller codebooks; none, no rows.
    Vectors of length 0 have code 0 and error 0. Null labels are one label. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "codes")
    stored = scratch.store(_usable(vectors), "ints")
    books = train(stored)
    label = stored.schema["label"].dataType.simpleString()
    if books is None:
        return stored.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
                             F.lit("").alias("codebooks_sha256"))
    coded = scratch.store(stored.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long"), "codes")
    totals = scratch.store(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    size = totals.agg(F.sum(32 + F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0)))).first()[0]
    if size <= BROADCAST_BYTES:
        named = coded.alias("a").join(F.broadcast(totals).alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        copies = totals.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        named = salted.alias("a").join(
            copies.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return named.select("a.vec_id", "a.code", "a.error", "b.label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
