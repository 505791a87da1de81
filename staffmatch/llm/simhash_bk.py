"""Near-duplicate documents by SimHash, with Burkhard-Keller trees over shards of fingerprints.

Fingerprints at most r bits apart agree in one of r + 1 disjoint bands at least, so the distinct fingerprints are
dealt to shards by (band, value of the band) and every shard is searched with its own tree. A tree travels to its
task by the shuffle, not through the driver: trees over all documents have no size bound, so they may not be
broadcast. A shard beyond `shard_limit` fingerprints is dealt again by the same rule: its members agree in the band and
may differ in the other bits only, which are cut into three bands of their own. After LEVELS cuts 14 bits are left at
the most, so no tree has more than 16,384 nodes then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.bktree import Forest, merge_labels
from staffmatch.llm.components import connected_components
from staffmatch.llm.scratch import Scratch
from staffmatch.llm.words import pieces

SEED = 42
RADIUS = 2
SHINGLE_WORDS = 3
#: Fingerprints of one tree; larger shards are cut again.
SHARD_LIMIT = 8192
#: Cuts after which a shard's members can differ in 14 bits at the most.
LEVELS = 4
#: Tree nodes times queries that one search step may hold.
FRONTIER = 4 << 20


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[:len(words) - shingle_words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1:] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def _tree_edges(values: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
    """Star edges of the near fingerprints of whole shards; `starts` are the shards' first rows."""
    sizes = np.diff(np.append(starts, len(values)))
    forest = Forest(values, np.repeat(starts, sizes))
    labels, n, step = np.arange(len(values)), len(values), max(1, FRONTIER // int(sizes.max()))
    for low in range(0, n, step):
        a, b = forest.within(np.arange(low, min(low + step, n)), RADIUS)
        labels = merge_labels(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(n))
    if not linked.size:
        return None
    signed = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[labels[linked]])], ["a", "b"])


def _search_shards(batches) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (band, key): shards are gathered until they are worth a search; an open shard waits."""
    band, key, fp = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def searched(upto: int):
        starts = np.flatnonzero(np.append(True, (band[1:upto] != band[:upto - 1]) | (key[1:upto] != key[:upto - 1])))
        return _tree_edges(fp[:upto].view(np.uint64), starts)

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "key", "fp")]
        band, key, fp = (np.concatenate(x) for x in zip((band, key, fp), new))
        if len(fp) >= 65_536:
            changes = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
            if changes.size:
                if (out := searched(int(changes[-1]))) is not None:
                    yield out
                band, key, fp = (x[changes[-1]:] for x in (band, key, fp))
    if len(fp) and (out := searched(len(fp))) is not None:
        yield out


def _cuts(mask: int) -> list[int]:
    """The masks that add one of RADIUS + 1 bands of the bits outside `mask` to it."""
    free = [b for b in range(64) if not mask >> b & 1]
    ends = [len(free) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in free[low:high]) for low, high in zip(ends, ends[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_edges(fingerprints: DataFrame, scratch: Scratch, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (`fp`) within RADIUS bits of each other."""
    masks, edges = [0], None
    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("band"))
    for level in range(1, LEVELS + 1):
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _cuts(m)]))])
        bands = (rows.select("fp", F.explode(finer[F.col("band")]).alias("band"))
                 .select("band", F.col("fp").bitwiseAND(F.col("band")).alias("key"), "fp"))
        if level > 1:
            bands = bands.distinct()  # two ways of cutting may end in one band
        sizes = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = bands.join(sizes, ["band", "key"])
        small = dealt if level == LEVELS else dealt.where(F.col("n") <= shard_limit)
        trees = (small.select("band", "key", "fp").repartition("band", "key").sortWithinPartitions("band", "key", "fp")
                 .mapInArrow(_search_shards, "a long, b long"))
        edges = trees if edges is None else edges.unionByName(trees)
        if level == LEVELS:
            break
        rows = scratch.store(dealt.where(F.col("n") > shard_limit).select("fp", "band"), f"large-{level}")
        if rows.isEmpty():
            break
        masks = sorted({c for m in masks for c in _cuts(m)})
    return edges


def near_duplicates(docs: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs` (doc_id, text; other columns are ignored).

    Exact copies and equal fingerprints are one class from the start, so a group of copies of any size costs one
    fingerprint. A null or empty text has fingerprint zero and links like any other. Repeated rows come out once
    each; a null doc_id gets the smallest non-null id of its component, null if there is none. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.store(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"),
        "fingerprints")
    distinct = scratch.store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    edges = near_edges(distinct, scratch, shard_limit)
    nodes = connected_components(edges.select("a", "b"), scratch)
    classes = (distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "first_doc", F.coalesce("component", "fp").alias("component")))
    heads = classes.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = scratch.store(classes.join(heads, "component").select("fp", "component_id"), "classes")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
