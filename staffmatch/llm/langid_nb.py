"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counting is a distributed sum of (language, bucket) counts; only the matrix of languages x BUCKETS log
probabilities reaches the driver and is broadcast, whatever the size of the corpus. Texts are scored in batches: the
rows of the matrix at a text's n-gram buckets are summed per text in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staffmatch.llm.sampling import bounded_sample, held_out
from staffmatch.llm.words import pieces

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Labelled documents that the counts are taken from, about; a parameter of `fit`.
TRAIN_DOCS = 20_000
SMOOTHING = 0.5
#: Text bytes, and n-grams within them, that are held at a time.
PIECE, STEP = 1 << 20, 1 << 18
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages
    log_prior: np.ndarray


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the bucket of every n-gram of the lower-cased texts, and the index of each text's first (one more at the end)."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([0, *map(len, lowered)])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashed = codes * _FACTORS[0]
    for order in ORDERS:
        if order > 1:
            hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * _FACTORS[1] + codes[order - 1:] * _FACTORS[2]
        if not len(hashed):
            return
        mixed = (hashed ^ (hashed >> np.uint32(13))) * _FACTORS[1]
        buckets = (mixed >> np.uint32(18)).astype(np.int64)  # 14 bits
        inside = np.ones(len(hashed), dtype=bool)
        for back in range(1, order):
            cut = ends[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(hashed))]] = False
        firsts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(ends, len(hashed))]
        yield buckets[inside], firsts


def _count(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in pieces(batches, "text", PIECE):
        langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
        for lang in np.unique(langs):
            total = counts.setdefault(str(lang), np.zeros(BUCKETS, dtype=np.int64))
            for buckets, _ in ngram_buckets([t or "" for t, own in zip(texts, langs == lang) if own]):
                total += np.bincount(buckets, minlength=BUCKETS)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
            ["lang", "bucket", "n"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the rows of `docs` (doc_id, text, lang) that have a language and a text and are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sample = bounded_sample(usable, "doc_id", train_docs).select(F.col("lang").cast("string").alias("lang"), "text")
    table = (sample.mapInArrow(_count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # languages x BUCKETS at most
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    at = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
    counts[table.column("bucket").to_numpy().astype(np.int64), at] += table.column("n").to_numpy()
    total = np.array([sizes[x] for x in languages], dtype=np.float64)
    return Model(languages, np.log(counts / counts.sum(axis=0)), np.log(total / total.sum()) if languages else total)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The best language of every text and its posterior; UNKNOWN and 0 for a null text or one without a letter."""
    known = [t is not None and _LETTER.search(t) is not None for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    joint = np.tile(model.log_prior, (len(texts), 1))
    for buckets, firsts in ngram_buckets([t if ok else "" for t, ok in zip(texts, known)]):
        some = np.flatnonzero(np.diff(firsts))
        bounds = np.append(firsts[some], len(buckets))
        for low in range(0, len(buckets), STEP):  # a long text spans several steps
            high = min(low + STEP, len(buckets))
            a, b = np.searchsorted(bounds, low, side="right") - 1, np.searchsorted(bounds, high, side="left")
            joint[some[a:b]] += np.add.reduceat(model.log_prob[buckets[low:high]], np.maximum(bounds[a:b], low) - low, axis=0)
    best = joint.argmax(axis=1)
    scores = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
    return ([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, scores, 0.0))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with `lang_pred` and `score` (0 to 1) of the whole text.

    A column of `docs` with one of these two names is replaced. Null and letterless texts give `und` and 0, and so
    does every text if there was nothing to learn from. Rows, repeated or not, come out once each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            names, scores = score_texts(Model(*shared.value), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    source = docs.select(*kept)
    schema = StructType([*source.schema.fields]).add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)
