"""Quality rules whose cutoffs follow the data: quantile sketches per language and source set the thresholds.

Every measure is an integer per document. A sketch of a measure is the table of its counts per logarithmic bucket
(exact below 64, then 32 buckets per power of two, so a quantile is at most 1/32 too high). Sketches merge by adding
counts, in any order and with the same result: a group's sketch, its language's and the corpus's come from the same
rows. A document is rejected where a measure lies above the upper fence of its group, Q3 + FENCE * (Q3 - Q1 + slack).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffmatch.llm.words import PIECE_BYTES, SPACE, pieces, row_of, split_words, text_bytes, word_codes

WINDOW_WORDS = 5
#: Measures with an upper fence, in thousandths (of characters, lines or words) or characters.
MEASURES = ("symbol_permille", "dup_line_permille", "repeat_permille", "word_length_permille")
FENCE = 3
#: Added to the spread, so that a group whose documents are all alike does not reject the least deviation.
SLACK = 25
#: A fence is drawn towards that of the group around it, as if that stood for so many documents of its own.
PRIOR_DOCS = 50

SCHEMA = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, n_lines long")

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(codes: np.ndarray, starts: np.ndarray, width: int = WINDOW_WORDS) -> np.ndarray:
    """Per row, the words that lie in a window of `width` words found twice or more in that row."""
    n = len(codes) - width + 1
    rows = row_of(starts)
    if n <= 0:
        return np.zeros(len(starts) - 1, dtype=np.int64)
    keys = rows[:n].astype(np.uint64)
    for j in range(width):
        keys = (keys * _MULTIPLIER) ^ (keys >> np.uint64(29))
        keys += codes[j:j + n].astype(np.uint64) + np.uint64(1)
    keys = np.where(rows[:n] == rows[width - 1:], keys * _MULTIPLIER, 0)
    whole = np.flatnonzero(rows[:n] == rows[width - 1:])
    order = whole[np.argsort(keys[whole], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    equal = rows[a] == rows[b]
    for j in range(width):  # equal keys are checked word by word
        equal &= codes[a + j] == codes[b + j]
    marks = np.zeros(len(codes) + 1, dtype=np.int64)
    heads = np.zeros(n, dtype=bool)
    heads[a[equal]] = heads[b[equal]] = True
    at = np.flatnonzero(heads)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(rows[covered], minlength=len(starts) - 1)


def duplicate_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the lines with a word and how many of them equal an earlier line."""
    data, rows = text_bytes(column)
    breaks = data == 0x0A
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[1:] = breaks
    starts[rows] = True
    at = np.flatnonzero(starts[:-1])
    n = len(rows) - 1
    if not at.size:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    # A line break stays with its line except at the end of the text: cut it off everywhere.
    lengths = np.diff(np.append(at, len(data)))
    lengths -= breaks[at + lengths - 1]
    worded = np.add.reduceat(~SPACE[data], at, dtype=np.int64) > 0
    at, lengths = at[worded], lengths[worded]
    ends = np.cumsum(lengths)
    take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(at, lengths)
    lines = pa.Array.from_buffers(pa.large_binary(), len(at), [
        None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[take])])
    codes, _ = word_codes(lines)
    owner = np.searchsorted(rows, at, side="right") - 1
    total = np.bincount(owner, minlength=n)
    distinct = np.unique(owner * (len(at) + 1) + codes) // (len(at) + 1)
    return total, total - np.bincount(distinct, minlength=n)


def _measures(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        text = batch.column("text")
        words, starts = split_words(text)
        codes, distinct = word_codes(words)
        chars = pc.utf8_length(distinct.cast(pa.large_string())).to_numpy(zero_copy_only=False)
        n_words = np.diff(starts)
        totals = np.append(0, np.cumsum(chars[codes] if len(codes) else np.zeros(0, dtype=np.int64)))
        lines, dup_lines = duplicate_lines(text)
        symbols = pc.fill_null(pc.count_substring_regex(text, r"[#*$%&|<>]"), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(n_words),
             pa.array(totals[starts[1:]] - totals[starts[:-1]]), symbols, pa.array(dup_lines),
             pa.array(repeated_words(codes, starts)), pa.array(lines)],
            ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def document_measures(docs: DataFrame) -> DataFrame:
    """One row per document: the counts of the contract, the base rule and the measures in thousandths."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(_measures, SCHEMA)
    ratio = lambda part, whole: F.coalesce(F.expr(f"{part} * 1000 DIV nullif({whole}, 0)"), F.lit(0))
    return counts.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        ratio("n_symbols", "word_chars").alias("symbol_permille"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_permille"),
        ratio("n_repeat_words", "n_words").alias("repeat_permille"),
        ratio("word_chars", "n_words").alias("word_length_permille"))


def bucket(value: Column) -> Column:
    """The sketch bucket of a non-negative integer; `bucket_top` gives its largest value."""
    power = F.length(F.bin(value)) - 1
    scaled = value / F.pow(F.lit(2.0), power - 5)
    return F.when(value < 64, value).otherwise((power - 4) * 32 + F.floor(scaled)).cast("long")


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    power = F.floor(number / 32) + 3
    return F.when(number < 64, number).otherwise(
        ((number - (power - 4) * 32 + 1) * F.pow(F.lit(2.0), power - 5) - 1)).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each measure and group over documents that pass the base rule."""
    return (measures.where(~F.col("base_failed"))
            .select("lang", "source", F.explode(F.array(*[
                F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("s"))
            .groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count("*").alias("n")))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The upper fence of every measure and group, from sketches merged over `keys`."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # a sketch: a few hundred buckets at most
    ranked = (merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
              .withColumn("total", F.sum("n").over(group)))
    at = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("docs"))
    low, high = bucket_top(F.col("q1")), bucket_top(F.col("q3"))
    return quartiles.select(*keys, "measure", "docs", (high + FENCE * (high - low + SLACK)).alias("fence"))


def _wide(table: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """One row per group: a column per measure, and the number of documents."""
    return table.groupBy(*keys).agg(
        F.max("docs").alias(f"docs_{suffix}"),
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_{suffix}") for m in MEASURES])


def thresholds(measures: DataFrame) -> DataFrame:
    """One row per (lang, source) with the fence that holds there for every measure.

    Every group's own sketch counts by its number of documents: n documents and a fence f under a fence F make
    (n f + PRIOR_DOCS F) DIV (n + PRIOR_DOCS), the corpus around the languages, a language around its sources.
    """
    sketch = sketches(measures)
    own = _wide(fences(sketch, ["lang", "source"]), ["lang", "source"], "own")
    by_lang = _wide(fences(sketch, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "l")
    corpus = _wide(fences(sketch.withColumn("everything", F.lit(1)), ["everything"]), ["everything"], "all")
    table = (own.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).withColumn("everything", F.lit(1))
             .join(F.broadcast(corpus), "everything"))  # one row
    drawn = lambda docs, fence, around: f"({docs} * {fence} + {PRIOR_DOCS} * ({around})) DIV ({docs} + {PRIOR_DOCS})"
    return table.select("lang", "source", *[
        F.expr(drawn("docs_own", f"{m}_own", drawn("docs_lang", f"{m}_lang", f"{m}_all"))).alias(f"{m}_fence") for m in MEASURES])


def apply_rules(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Measures with `kept`. The measures are joined to a table of one row per language and source."""
    named = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = measures.join(named, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"{m}_fence"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("t_lang", "t_source")


def quality(docs: DataFrame, scratch) -> DataFrame:
    """Every row of `docs` (doc_id, text, lang, source) with its measures, `base_failed` and `kept`.

    A null or empty text has no words and fails the base rule. Null languages and sources are groups of their own.
    Repeated rows each come out; an empty table gives an empty result; other columns are ignored.
    """
    measures = scratch.store(document_measures(docs), "measures")
    limits = scratch.store(thresholds(measures), "thresholds")
    return apply_rules(measures, limits)
