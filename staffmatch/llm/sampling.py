"""Bounded training samples, and the split of documents into learning and held-out ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by FOLDS; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


HASH_BITS = 60


def hash_limit(most: int, total: int) -> int:
    """Hashes of HASH_BITS bits below this limit are the share of `most` in `total`; above zero for any table there is."""
    return (most << HASH_BITS) // total


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at the most, picked by a hash of `key`; all rows if there are no more than that."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(key), 64 - HASH_BITS) < F.lit(hash_limit(most, total)))
