"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): `root` is the smallest node that can be reached.

    Alternates large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until only stars are left. Each step is an aggregate and a join; a hub's edges are pre-summed
    by the aggregate and its join is split by AQE. Edges live in checkpointed tables and only two numbers a round come to
    the driver. Self-loops, repeated and null edges change nothing; a node that only has these is not in the result.
    """
    edges = materialize(_downward(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_downward(large))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(_downward(small.unionByName(least.select("u", F.col("m").alias("v")))))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _downward(edges: DataFrame) -> DataFrame:
    """Every edge once, from its larger node `u` to its smaller node `v`."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
