"""Connected components by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of any comparable type. Returns (node, root): for each node of an edge the least node it can reach.

    A round joins every edge's smaller end with that end's least neighbour (large star), then gathers each node's smaller
    neighbours at their least one (small star). Rounds grow with the logarithm of the longest path; only counts reach the
    driver. Self-loops and repeated edges are allowed; without edges the result is empty.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(e.join(least, e["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        discard(large)
        discard(e)
        e, old, state = nxt, state, _state(nxt)
        if state == old:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._memlattice_path = e._memlattice_path  # discard(out) deletes the table behind it
    return out
