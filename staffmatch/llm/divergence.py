"""Source divergence audit: how far the word use of each source of a language lies from the others and from the whole.

Terms are runs of letters (A-Z folded) and of characters beyond ASCII; a language keeps the terms of at least
LEAST_DOCS of its documents. With count occurrences of a kept term among N in a group and V kept terms, all in integers,

    p = 1 + floor(SCALE * (count + 2) / (N + 2 V))        f(p, q) = floor((p - q)^2 / (p + q))

Part `pair` sums f over all kept terms for two sources of a language. A block of terms meets all sources of its
language as one integer matrix of bounded size; blocks are summed by Spark.

Part `term` ranks the terms that a group uses more than its language does. f grows with the group's count and falls with
the language's, and ties go to the earlier term, so a term that TOP others dominate (group count at least as high,
language count at most as high, earlier in UTF-8) can't be among the first TOP. Every partition retains its dominance
skyband, the terms that fewer than TOP others of it dominate; skybands are merged in slices, then per group, and only
what is left is ranked by exact value. Dominance is transitive, so dropping a term loses no dominator that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmatch.llm.scratch import Scratch
from staffmatch.llm.words import binary_array, pieces, row_of, split_words, text_bytes, word_codes

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Text bytes counted at a time in a task.
COUNT_BYTES = 8 << 20
#: Sources x terms of one block of the pair sums.
BLOCK_CELLS = 1 << 17
#: Partitions whose skybands are merged together before a group's skybands meet in one task.
SLICES = 32
#: Candidates compared with a skyband at a time.
STEP_ROWS = 256

# Bytes of terms: A-Z folded, other letters and bytes beyond ASCII as they are; all else separates.
FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per group and term of a piece of text, and one without a term per group."""
    for batch in pieces(batches, "text", COUNT_BYTES):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        packed = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, group = np.unique(packed, return_inverse=True)
        data, rows = text_bytes(batch.column("text"))
        words, starts = split_words(binary_array(FOLD[data], rows))
        codes, terms = word_codes(words)
        width = max(len(terms), 1)
        in_doc, n = np.unique(row_of(starts) * width + codes, return_counts=True)
        keys, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
        of_group = groups[np.concatenate([keys // width, np.arange(len(groups))])]
        term = pa.concat_arrays([terms.take(pa.array(keys % width)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
        zeros = np.zeros(len(groups), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(of_group // len(source.dictionary))).cast(pa.string()),
            source.dictionary.take(pa.array(of_group % len(source.dictionary))).cast(pa.string()), term,
            pa.array(np.concatenate([np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64), zeros])),
            pa.array(np.concatenate([np.bincount(at, minlength=len(keys)), zeros]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n, docs) per group and term, and a row with a null term per group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(*[blank(c) for c in ("lang", "source", "text")]).mapInArrow(
        _count_terms, "lang string, source string, term string, n long, docs long")
    return scratch.store(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def _weight(n: str, total: str) -> Column:
    """p of a term; null where the language keeps no term."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({wide(n)} + 2)) div nullif({wide(total)} + 2 * {wide('v')}, 0)")


class Skyband:
    """The rows of one group that fewer than k others seen dominate, offered in order of dominance."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, None

    def offer(self, rows: pa.Table) -> None:
        """Rows come by n descending, lang_n, term, so that no later row dominates an earlier one."""
        both = rows if self.held is None else pa.concat_tables([self.held, rows])
        term = both.column("term").combine_chunks()
        place = np.empty(len(both), dtype=np.int64)
        place[pc.sort_indices(term).to_numpy()] = np.arange(len(both))
        common = both.column("lang_n").to_numpy()
        kept = np.arange(0 if self.held is None else len(self.held))
        for start in range(len(kept), len(both), STEP_ROWS):
            step = np.arange(start, min(start + STEP_ROWS, len(both)))
            beaten = self._beaten(common, place, kept, step)
            alive, beaten = step[beaten < self.k], beaten[beaten < self.k]
            earlier = np.tri(len(alive), k=-1, dtype=bool)
            beaten = beaten + (earlier & self._dominate(common, place, alive, alive)).sum(axis=1)
            kept = np.concatenate([kept, alive[beaten < self.k]])
        self.held = both.take(pa.array(kept))

    @staticmethod
    def _dominate(common, place, by, rows) -> np.ndarray:
        return (common[by] <= common[rows][:, None]) & (place[by] < place[rows][:, None])

    def _beaten(self, common, place, by, rows) -> np.ndarray:
        return self._dominate(common, place, by, rows).sum(axis=1)


def _retain(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, group, part = None, None, TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            marks = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "source")]
            cuts = np.flatnonzero((np.diff(marks[0]) != 0) | (np.diff(marks[1]) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(batch)]):
                key = batch.column("lang")[int(start)].as_py(), batch.column("source")[int(start)].as_py()
                if key != group:
                    if band is not None:
                        yield from _out(band, part)
                    band, group = Skyband(k), key
                band.offer(pa.Table.from_batches([batch.slice(int(start), int(stop - start))]))
        if band is not None:
            yield from _out(band, part)

    return run


def _out(band: Skyband, part: int) -> Iterator[pa.RecordBatch]:
    held = band.held.select(["lang", "source", "term", "n", "lang_n"])
    yield from held.append_column("part", pa.array(np.full(len(held), part, dtype=np.int32))).to_batches()


def skybands(terms: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of `terms` (lang, source, term, n, lang_n) that fewer than k others of their group dominate."""
    schema = "lang string, source string, term string, n long, lang_n long, part int"

    def passed(rows: DataFrame) -> DataFrame:
        ordered = rows.sortWithinPartitions("lang", "source", F.desc("n"), "lang_n", "term")
        return ordered.select("lang", "source", "term", "n", "lang_n").mapInArrow(_retain(k), schema)

    parts = passed(terms)
    slices = passed(parts.repartition("lang", "source", F.pmod("part", F.lit(SLICES))))
    return passed(slices.repartition("lang", "source")).drop("part")


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums of f over one block of terms for every two sources, each pair once."""
    heads = table.filter(pc.is_null(table.column("term")))
    body = table.filter(pc.is_valid(table.column("term")))
    names = heads.column("source").combine_chunks()
    absent = heads.column("p").to_numpy()
    terms = body.column("term").combine_chunks().dictionary_encode()
    weights = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
    weights[pc.index_in(body.column("source").combine_chunks(), value_set=names).to_numpy(),
            terms.indices.to_numpy()] = body.column("p").to_numpy()
    first, second, values = [], [], []
    for a in range(len(names) - 1):
        gap = weights[a + 1:] - weights[a]
        values.append((gap * gap // (weights[a + 1:] + weights[a])).sum(axis=1))
        first.append(np.full(len(values[-1]), a))
        second.append(np.arange(a + 1, len(names)))
    pick = lambda x: names.take(pa.array(np.concatenate([*x, np.zeros(0)]).astype(np.int64)))
    return pa.table({
        "lang": pa.repeat(table.column("lang")[0], sum(map(len, values))), "source": pick(first), "item": pick(second),
        "value": pa.array(np.concatenate([*values, np.zeros(0)]).astype(np.int64))})


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for every other source of the language, part `term` for the
    TOP terms of each group that it uses more than its language does.

    Null text, lang and source are read as ''. Repeated rows and rows without an id count as documents of their own.
    Documents without a term make their group occur all the same; a language that keeps no term has pairs of value 0
    and no term rows, a single source no pairs. Empty tables give no rows. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    counts = term_counts(docs, scratch)
    used = counts.where("term IS NOT NULL")
    terms = scratch.store(used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                          .where(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")
    kept = scratch.store(used.drop("docs").join(terms, ["lang", "term"]), "kept")
    occurring = counts.where("term IS NULL").select("lang", "source")
    langs = (occurring.groupBy("lang").agg(F.count("*").alias("sources"))
             .join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
             .fillna(0, ["v", "lang_total"])
             .withColumn("blocks", F.expr(f"greatest(1, ceil(v * sources / {BLOCK_CELLS}))").cast("long")))
    groups = scratch.store(occurring.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
                           .fillna(0, ["total"]).join(langs, "lang"), "groups")

    weighed = kept.join(groups, ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    cells = weighed.select("lang", block, "source", "term", _weight("n", "total").alias("p"))
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("string").alias("term"), F.coalesce(_weight("0", "total"), F.lit(0)).alias("p"))
    sums = (cells.unionByName(heads).groupBy("lang", "block")
            .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = sums.select("lang", "value", F.explode(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way"))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    rising = skybands(kept).join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _weight("n", "total").alias("p"), _weight("lang_n", "lang_total").alias("q")).where("p > q")
    rising = rising.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return _ranked(pairs).unionByName(_ranked(rising).where(F.col("rank") <= TOP))
