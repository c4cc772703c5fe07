"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import Stash


def _to_least(arcs: DataFrame, keep: str) -> DataFrame:
    """For each node u, an edge from each neighbour v that ``keep`` admits, and from u, to the least of u and those."""
    near = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if keep == "larger" else arcs.where("v < u").groupBy("u").agg(F.min("v").alias("m"))
    # The join deals each node's neighbours out anew where they are many; the aggregate above sends one row a node and task.
    out = arcs.where("v > u" if keep == "larger" else "v < u").join(near.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep != "larger":
        out = out.unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, stash: Stash, rounds: int = 60) -> DataFrame:
    """(id, component): for every node of ``edges`` (columns u, v) the smallest id that it reaches.

    Large-star and small-star rounds alternate until the edges stay as they are; each round is a written table. Loops and
    repeated edges do no harm; nodes without an edge to another node are not returned; no edges give an empty table.
    """
    now = stash.put(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stash.put(_to_least(both, "larger"))
        small = stash.put(_to_least(large, "smaller"))
        sign = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stash.drop(now, large)
        now = small
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return least.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
