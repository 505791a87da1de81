"""Column-level vector helpers: ids, norms, inner products of already paired vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities are kept on this decimal grid. It is far finer than float32 storage and makes ranks
# independent of the summation order inside a block product, so results do not move with partitioning.
SIMILARITY_DIGITS = 9


def hash60(value: Column) -> Column:
    """The first 15 hex digits of SHA-256 as BIGINT."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("bigint")


def vector_id(employee_id: Column) -> Column:
    return hash60(employee_id)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """Unit vector as ARRAY<FLOAT>; a zero vector stays zero."""
    norm = l2_norm(vec)
    return F.when(norm > 0, F.transform(vec, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vec)


def inner_product(a: Column, b: Column) -> Column:
    """Inner product in double precision; for pairs that are already joined."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def require_dim(vec: Column, dim: int) -> Column:
    """The vector itself; the query fails when its length is not ``dim``."""
    message = F.concat(F.lit(f"vector dimension must be {dim}, found "), F.size(vec).cast("string"))
    return F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(message).cast("array<float>"))
