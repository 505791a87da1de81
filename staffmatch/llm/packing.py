"""Best-fit packing into bins of several permitted lengths.

Documents are dealt to shards of bounded size by a hash of their id, and every shard is packed on its own: longest
first, each into the open bin with the least room that takes it. Where none does, the bin size with the least cost per
expected word is opened. A shard is packed once for every permitted largest size, the cheapest outcome stays, and in
the end every bin shrinks to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Pieces of one shard. Only its last bins may be emptier than in one packing of everything.
SHARD_ROWS = 50_000


def sequence_cost(capacity: int) -> float:
    """Relative cost of training on one sequence: a part per word and a part per pair of words."""
    return capacity * (1 + capacity / 8192)


def pack_shard(lengths: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and start within the bin per piece (lengths in descending order), and the capacity per bin."""
    best = None
    for most in range(len(capacities)):
        sizes = capacities[:most + 1]
        if len(lengths) and lengths[0] > sizes[-1]:
            continue
        outcome = _best_fit(lengths, sizes, cost)
        total = sum(map(cost, outcome[2]))
        if best is None or total < best[0]:
            best = total, outcome
    bins, starts, sizes = best[1]
    return np.array(bins, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _best_fit(lengths: np.ndarray, sizes: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    filled: list[int] = []
    opened: list[int] = []
    bins, starts, left = [], [], int(lengths.sum())
    for length in lengths.tolist():
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            # What a new bin will hold: this piece and, as far as there are any, shorter ones.
            room = min((c for c in sizes if c >= length), key=lambda c: (cost(c) / min(c, left), c))
            number = len(filled)
            filled.append(0)
            opened.append(room)
        bins.append(number)
        starts.append(filled[number])
        filled[number] += length
        left -= length
        if room - length > 0:
            insort(rooms, (room - length, number))
    return bins, starts, [sizes[bisect_left(sizes, f)] for f in filled]


def _pack(capacities: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").to_numpy(zero_copy_only=False)
        part, length = (table.column(c).to_numpy() for c in ("part", "length"))
        order = np.lexsort((part, doc, -length))
        bins, starts, sizes = pack_shard(length[order], capacities)
        used = np.bincount(bins, weights=length[order], minlength=len(sizes)).astype(np.int64)
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(order)), "part": pa.array(part[order]), "length": pa.array(length[order]),
            "shard": table.column("shard").take(pa.array(order)), "bin": pa.array(bins), "start": pa.array(starts),
            "capacity": pa.array(sizes[bins]), "used": pa.array(used[bins])})
    return run


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, part, length, shard, bin, start, capacity, used) per piece of `lengths` (doc_id, length).

    A document longer than the largest capacity is cut into parts of that capacity and a rest. A null or
    non-positive length gives no piece. Repeated rows are packed once each. Bins are numbered within their shard;
    `used` is what a bin holds. An empty table gives an empty result; other columns are ignored.
    """
    sizes = tuple(sorted(set(capacities)))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities have to be positive")
    most = sizes[-1]
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length")).where("length > 0")
    parts = rows.select("doc_id", "length", F.explode(F.expr(f"sequence(0L, (length - 1) DIV {most})")).alias("part"))
    parts = parts.withColumn("length", F.least(F.lit(most), F.col("length") - F.col("part") * most))
    shards = max(1, math.ceil(parts.count() / shard_rows))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        _pack(sizes), "doc_id long, part long, length long, shard long, bin long, start long, capacity long, used long")


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length): the words of every whole text; a null text has none."""
    from staffmatch.llm.words import pieces, split_words

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, starts = split_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts).astype(np.int64))], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, length long")
