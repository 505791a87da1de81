"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two aggregations and two joins on the edge table, so a component of any size is spread over all
tasks; nothing but two check sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.scratch import Scratch

#: Rounds after which something is wrong with the input; the method needs about log2 of the longest chain.
MAX_ROUNDS = 60


def _downhill(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return (pairs.where("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
    smallest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _downhill(moved.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    Self-loops are ignored; a node without another end is not returned.
    """
    current = scratch.store(_downhill(edges), f"{name}-0")
    mark = _mark(current)
    for step in range(1, MAX_ROUNDS + 1):
        if not mark[0]:
            break
        following = scratch.store(_round(current), f"{name}-{step}")
        new_mark = _mark(following)
        current = following
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
