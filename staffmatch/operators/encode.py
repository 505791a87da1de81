"""Text to vector. One interface for the built-in encoder and for any batch encoder of the caller."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEXTS = 1024  # texts counted at once
_HELD_WORDS = 1 << 18  # buckets of words that a task remembers at once
_HELD_BYTES = 64  # longer words are hashed each time


def _bucket_counts(texts: list[bytes], dim: int, held: dict[bytes, int]) -> np.ndarray:
    """How many words of each text fall into each bucket; a word is hashed once as long as ``held`` has it."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        counted = Counter(text.split())  # of bytes: at ASCII white space
        buckets = []
        for word in counted:
            bucket = held.get(word)
            if bucket is None:
                bucket = int(sha256(word).hexdigest()[:15], 16) % dim
                if len(word) <= _HELD_BYTES:
                    if len(held) >= _HELD_WORDS:
                        held.clear()
                    held[word] = bucket
            buckets.append(bucket)
        if buckets:
            row += np.bincount(buckets, weights=list(counted.values()), minlength=dim)
    return out


class HashingEncoder:
    """Unit-length counts of hashed words; deterministic, needs no model file.

    A word is a run of characters other than ASCII white space, in lower case; its bucket is ``hash60`` modulo
    the dimension, which any SQL engine can compute. Counting takes place in Arrow batches, where a task hashes a word once
    and not once per occurrence.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.model = f"hashed-words-{dim}"

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``text`` replaced by ``vec``."""
        dim = self.dim

        @F.arrow_udf("array<float>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held: dict[bytes, int] = {}
            for texts in batches:
                parts = []
                for start in range(0, max(len(texts), 1), _TEXTS):
                    counts = _bucket_counts(texts.slice(start, _TEXTS).to_pylist(), dim, held)
                    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                    parts.append(np.divide(counts, norms, out=counts, where=norms > 0).astype(np.float32).reshape(-1))
                ends = np.arange(len(texts) + 1, dtype=np.int32) * dim
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))

        kept = [c for c in rows.columns if c != text]
        return rows.select(*kept, vectors(F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("vec"))


class BatchEncoder:
    """Wraps ``load() -> encode(list[str]) -> array (n, dim)``.

    ``load`` runs once per Python task stream on the executor. A text that cannot be encoded (an
    exception, a wrong shape, a non-finite value) fails the task and with it the whole run, so
    nothing half-finished is ever published.
    """

    def __init__(self, model: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32):
        self.model, self.dim, self.load, self.batch_size = model, dim, load, batch_size

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        load, dim, size = self.load, self.dim, self.batch_size

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in batches:
                out = np.empty((len(texts), dim), dtype=np.float64)
                for start in range(0, len(texts), size):
                    part = texts.iloc[start:start + size].tolist()
                    got = np.asarray(encode(part), dtype=np.float64)
                    if got.shape != (len(part), dim):
                        raise ValueError(f"encoder gave shape {got.shape}, expected {(len(part), dim)}")
                    if not np.isfinite(got).all():
                        raise ValueError("encoder gave a non-finite value")
                    out[start:start + size] = got
                norms = np.linalg.norm(out, axis=1, keepdims=True)
                unit = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
                yield pd.Series(list(unit.astype(np.float32)))

        kept = [c for c in rows.columns if c != text]
        return rows.select(*kept, vectors(text).alias("vec"))


def encode_profiles(profiles: DataFrame, encoder) -> DataFrame:
    """``employee_id, vec``."""
    return encoder.encode(profiles.select("employee_id", F.col("profile_text").alias("text")))


def encode_requirements(requirements: DataFrame, encoder) -> DataFrame:
    """The requirements with ``vec``, encoded by the same encoder as the employees."""
    from ..functions.text import requirement_embedding_text

    return encoder.encode(requirements.withColumn("text", requirement_embedding_text()))


class LookupEncoder:
    """Vectors computed elsewhere, keyed by ``id_column``; an id without a vector fails the run."""

    def __init__(self, model: str, vectors: DataFrame, id_column: str = "employee_id"):
        self.model, self.vectors, self.id_column = model, vectors, id_column

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        found = rows.drop(text).join(self.vectors.select(self.id_column, "vec"), self.id_column, "left")
        message = F.concat(F.lit("no vector for "), F.col(self.id_column))
        return found.withColumn("vec", F.coalesce("vec", F.raise_error(message).cast("array<float>")))
