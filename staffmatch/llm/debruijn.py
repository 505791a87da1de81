"""Repeated word spans across documents by De Bruijn compaction.

A k-mer of k consecutive words is an edge between its (k-1)-word ends. Edges that documents share are compacted:
where every occurrence of an edge is followed by the same word, and the following edge occurs no more often than that,
the two belong to one nonbranching path, and a path is then a single span at its first source coordinate (smallest
document, smallest position). Only the heads of paths are joined back to their occurrences.

Steps, all shuffled by Spark:
1. Exact copies of a whole text form a class; later copies need no edges, their class says all.
2. Seeds: of the SEED_WORDS-word grams of a k-mer the one with the least hash. Equal k-mers have equal seeds, so only
   k-mers whose seed occurs in two classes can be shared. This sends about a fifth of the words, not all.
3. Edges: k-mers with a shared seed, with a hash and the word after.
4. Paths, and the spans of later documents that repeat them.
5. Every span and its source are digested from the words themselves and compared; a difference (two k-mers with one
   hash) starts all over with another hash seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from staffmatch.llm.scratch import Scratch
from staffmatch.llm.words import pieces, row_of, split_words, word_codes

K = 13
SEED_WORDS = 5
#: Tasks that the copies of one text are shared out over.
SALTS = 16
#: Hash seeds to try before giving up.
ATTEMPTS = 3

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all rows, and the index of each row's first word (one more at the end)."""
    words, starts = split_words(column)
    codes, distinct = word_codes(words)
    table = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    return table[codes] if len(codes) else table, starts


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash per `width` consecutive words."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= _MULT
        out += words[j:j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _whole(starts: np.ndarray, width: int) -> np.ndarray:
    """The first words of the k-mers that lie in one row."""
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[:-1] - (ends - counts), counts)


def kmer_seeds(words: np.ndarray, k: int) -> np.ndarray:
    """The least gram hash within every run of k words."""
    grams = gram_hashes(words, SEED_WORDS)
    span = k - SEED_WORDS + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    least, done = grams, 1
    while done < span:  # minimum over doubling spans
        step = min(done, span - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    return least


def _seed_rows(k: int, seed: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, starts = word_hashes(batch.column("text"), seed)
            at = _whole(starts, k)
            rows, seeds = row_of(starts)[at], kmer_seeds(words, k)[at]
            new = np.append(True, (seeds[1:] != seeds[:-1]) | (rows[1:] != rows[:-1]))[:len(seeds)]
            rows, seeds = rows[new], seeds[new]
            order = np.lexsort((seeds, rows))
            rows, seeds = rows[order], seeds[order]
            new = np.append(True, (seeds[1:] != seeds[:-1]) | (rows[1:] != rows[:-1]))[:len(seeds)]
            take = pa.array(rows[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds[new].view(np.int64)), batch.column("doc_id").take(take), batch.column("class").take(take)],
                ["seed", "doc_id", "class"])
    return run


def _edge_rows(k: int, seed: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, starts = word_hashes(batch.column("text"), seed)
            at = _whole(starts, k)
            if not len(at):
                continue
            rows, seeds = row_of(starts)[at], kmer_seeds(words, k)[at]
            shared = batch.column("seeds")
            wanted = np.unique(shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            maybe = np.isin(seeds, wanted)
            at, rows, seeds = at[maybe], rows[maybe], seeds[maybe]
            own_counts = np.diff(shared.offsets.to_numpy())
            own = np.repeat(np.arange(len(batch)), own_counts).astype(np.uint64)
            mixed = lambda row, s: (row.astype(np.uint64) * _MULT) ^ (s * _MIX)
            mine = np.isin(mixed(rows, seeds), mixed(own, shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
            at, rows = at[mine], rows[mine]
            hashes = gram_hashes(words, k)[at]
            # The word after it; -1 at the end of the document.
            low = (words >> np.uint64(33)).astype(np.int64)
            after = np.where(at + k < starts[rows + 1], low[np.minimum(at + k, len(low) - 1)], -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("doc_id").take(pa.array(rows)),
                 pa.array((at - starts[rows]).astype(np.int32)), pa.array(after.astype(np.int32))],
                ["h", "doc_id", "pos", "nxt"])
    return run


def copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_of): every later copy of a whole text, and the smallest id that has that text.

    A text may have very many copies: they are reduced on the map side, and shared out over SALTS tasks for the join.
    """
    keyed = docs.select("doc_id", F.md5("text").alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    salted = first.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return (keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, ["key", "salt"])
            .where("doc_id > first").select("doc_id", F.col("first").alias("copy_of")).distinct())


def shared_seeds(docs: DataFrame, copies: DataFrame, scratch: Scratch, k: int, seed: int) -> DataFrame:
    """(doc_id, seeds): per document that is no later copy, its seeds that another class has, too."""
    found = scratch.store(docs.select("doc_id", F.xxhash64("text").alias("class"), "text")
                          .mapInArrow(_seed_rows(k, seed), "seed long, doc_id long, class long"), f"seeds-{seed}")
    twice = (found.groupBy("seed").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("seed"))
    hits = found.join(twice, "seed").join(copies, "doc_id", "left_anti")
    per_doc = scratch.store(hits.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), f"hits-{seed}")
    scratch.drop(f"seeds-{seed}")
    return per_doc


def repeated_spans(docs: DataFrame, copies: DataFrame, scratch: Scratch, k: int, seed: int, floors: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, length, source_doc, source_pos), in words: spans that repeat a path of a smaller document.

    `floors` (doc_id, floor) names the documents that only count as larger than those below `floor`.
    """
    hits = shared_seeds(docs, copies, scratch, k, seed)
    edges = scratch.store(docs.join(hits, "doc_id").select("doc_id", "text", "seeds")
                          .mapInArrow(_edge_rows(k, seed), "h long, doc_id long, pos int, nxt int"), f"edges-{seed}")
    distinct = scratch.store(
        edges.groupBy("h").agg(
            F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"),
            F.min("nxt").alias("nxt"), F.max("nxt").alias("nxt_max"))
        .where("first.doc_id < last")
        .select("h", F.col("first.doc_id").alias("source_doc"), F.col("first.pos").alias("source_pos"), "times",
                ((F.col("nxt") == F.col("nxt_max")) & (F.col("nxt") >= 0)).alias("one_after")), f"kmers-{seed}")
    # Shared k-mers of one document in reading order: a new path starts wherever the step before it branches.
    order = Window.partitionBy("source_doc").orderBy("source_pos")
    continued = (F.lag("one_after", 1, False).over(order) & (F.lag("times").over(order) == F.col("times"))
                 & (F.lag("source_pos").over(order) == F.col("source_pos") - 1))
    marked = distinct.withColumn("head", F.coalesce(~continued, F.lit(True)))
    numbered = marked.withColumn("path", F.sum(F.col("head").cast("int")).over(order))
    paths = numbered.groupBy("source_doc", "path").agg(
        F.min("source_pos").alias("source_pos"), F.count("*").alias("n"), F.max(F.when(F.col("head"), F.col("h"))).alias("h"))
    met = edges.select("h", "doc_id", "pos").join(paths.select("h", "source_doc", "source_pos", "n"), "h").where("doc_id > source_doc")
    if floors is not None:
        met = met.join(floors, "doc_id", "left").where("source_doc < coalesce(floor, doc_id)")
    spans = scratch.store(
        met.select("doc_id", "pos", (F.col("n") + k - 1).cast("int").alias("length"), "source_doc", "source_pos"), f"spans-{seed}")
    scratch.drop(f"edges-{seed}", f"kmers-{seed}", f"hits-{seed}")
    return spans


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


_CHECKS = pa.list_(pa.struct([("source_doc", pa.int64()), ("source_pos", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())]))


def _removed(k: int):
    """Per document: what is left of it, and digests of the spans it repeats and of those that others repeat of it."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for doc, text, spans, sources, copy_of in zip(*(batch.column(c).to_pylist() for c in
                                                            ("doc_key", "text", "spans", "sources", "copy_of"))):
                words = (text or b"").split()
                covered, checks = np.zeros(len(words) + 1, dtype=np.int64), []
                if copy_of is not None and len(words) >= k:
                    covered[0] = 1  # whole
                for s in spans or []:
                    covered[s["pos"]] += 1
                    covered[s["pos"] + s["length"]] -= 1
                    checks.append((s["source_doc"], s["source_pos"], s["length"], _digest(words[s["pos"]:s["pos"] + s["length"]])))
                for s in sources or []:
                    checks.append((doc, s["pos"], s["length"], _digest(words[s["pos"]:s["pos"] + s["length"]])))
                left = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()] if covered.any() else words
                joined = b" ".join(left)
                out.append((text if len(left) == len(words) else joined, len(words), len(words) - len(left),
                            hashlib.sha256(joined).hexdigest(),
                            [dict(zip(("source_doc", "source_pos", "length", "digest"), c)) for c in sorted(set(checks))]))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.large_binary(), pa.int64(), pa.int64(), pa.string(), _CHECKS))]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), *made], ["carried", *_MADE])
    return run


_MADE = {"text": BinaryType(), "n_words": LongType(), "n_removed": LongType(), "kept_sha256": StringType(),
         "checks": ArrayType(StructType().add("source_doc", LongType()).add("source_pos", IntegerType())
                             .add("length", IntegerType()).add("digest", BinaryType()))}


def _numbered(texts: DataFrame, known: DataFrame, twofold: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`texts` with a number per id and text for `doc_key`, in the order of the ids, and the floors of ids with several.

    Running numbers over range-partitioned, sorted rows keep the order; the written table fixes them.
    """
    numbers = scratch.store(
        known.select("doc_id", F.md5("text").alias("digest")).distinct().repartitionByRange("doc_id", "digest")
        .sortWithinPartitions("doc_id", "digest").withColumn("number", F.monotonically_increasing_id()), "numbers")
    least = numbers.join(twofold, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("number").alias("floor"))
    floors = scratch.store(numbers.join(least, "doc_id").select(F.col("number").alias("doc_id"), "floor"), "floors")
    named = numbers.select(F.col("doc_id").alias("doc_key"), "digest", "number")
    keyed = texts.withColumn("digest", F.md5("text")).join(named, ["doc_key", "digest"], "left")
    return scratch.store(keyed.select("carried", F.col("number").alias("doc_key"), "text"), "texts"), floors


def remove_repeats(docs: DataFrame, k: int = K, hash_seed: int = 1) -> DataFrame:
    """Every row of `docs` (doc_id, text and any others) without the words that repeat an earlier document.

    Removed is every word in a run of `k` words that also starts in a document with a smaller id; runs are judged on
    the input. `text` is the kept words joined by one space where words went, and as it was elsewhere; added are
    n_words, n_removed and kept_sha256 (of the kept words joined by one space); columns of these names in `docs` are
    replaced. A null or empty text has no words. Within one document nothing counts as a repeat. Repeated rows each
    come out. Where an id stands on several texts, each is a document of its own: none of them repeats another, smaller
    ids take words from each, and each takes words from larger ids. A null id neither removes nor loses words. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in _MADE]).alias("carried")
    texts = docs.select(carried, F.col("doc_id").cast("long").alias("doc_key"), F.col("text").cast("binary").alias("text"))
    known = texts.select(F.col("doc_key").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    twofold = scratch.store(known.groupBy("doc_id").agg(F.min(F.md5("text")).alias("a"), F.max(F.md5("text")).alias("b"))
                            .where("a <> b").select("doc_id"), "twofold")
    floors = None
    if not twofold.isEmpty():
        texts, floors = _numbered(texts, known, twofold, scratch)
        known = texts.select(F.col("doc_key").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    copies = scratch.store(copy_classes(known), "copies")
    schema = StructType([*docs.select(carried).schema.fields, *(StructField(n, t) for n, t in _MADE.items())])
    for seed in range(hash_seed, hash_seed + ATTEMPTS):
        spans = repeated_spans(known, copies, scratch, k, seed, floors)
        per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "length", "source_doc", "source_pos")).alias("spans"))
        sources = (spans.select("source_doc", "source_pos", "length").distinct()
                   .groupBy(F.col("source_doc").alias("doc_id"))
                   .agg(F.collect_list(F.struct(F.col("source_pos").alias("pos"), "length")).alias("sources")))
        notes = (per_doc.join(sources, "doc_id", "full").join(copies, "doc_id", "full")
                 .withColumnRenamed("doc_id", "doc_key"))
        result = scratch.store(texts.join(notes, "doc_key", "left").select("carried", "doc_key", "text", "spans", "sources", "copy_of")
                               .mapInArrow(_removed(k), schema), f"result-{seed}")
        unequal = (result.select(F.explode("checks").alias("c")).select("c.*")
                   .groupBy("source_doc", "source_pos", "length").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
                   .where("a <> b"))
        if unequal.isEmpty():
            return result.select("carried.*", F.col("text").cast("string").alias("text"), "n_words", "n_removed", "kept_sha256")
    raise RuntimeError(f"{ATTEMPTS} hash seeds in a row gave one hash to two k-mers")
