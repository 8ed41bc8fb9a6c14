"""Subtree sums of a forest held in a DataFrame, by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.session import materialize


def subtree_sums(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, *values) for every node of `tree` (node, parent, *values): each value summed over the node's subtree.

    `node` is unique and `parent` null at a root. Rounds of two steps shrink the forest until nothing is left: compress
    takes out every node with a single child, rake takes out every leaf and adds its sum to its parent. Both halve what
    they act on, so the rounds grow with the logarithm of the nodes, whatever the depth. Nodes that were taken out of
    chains are brought back last, round by round: each is its chain's sum down to a node whose total is known by then.

    All joins are on keys that are unique on both sides, and the sums that reach a parent are pre-aggregated, so a node
    with very many children is no hot key. Every round's tables are checkpointed; only counts reach the driver.
    """
    up = [f"{v}_up" for v in values]
    # `x_up`: what the contracted stretch above a node adds to the node's total on its way to `parent`.
    active = materialize(tree.select("node", "parent", *values, *[F.lit(0).cast("long").alias(u) for u in up]))
    chains, done = [], []
    while not active.isEmpty():
        active, chain = _compress(active, values, up)
        active, leaves = _rake(active, values, up)
        chains.append(chain)
        done.append(leaves)
    known = None
    for chain, leaves in zip(reversed(chains), reversed(done)):
        known = leaves if known is None else known.unionByName(leaves)
        if chain is not None:
            below = known.select(F.col("node").alias("to"), *[F.col(v).alias(f"{v}_below") for v in values])
            back = chain.join(below, "to").select("node", *[(F.col(v) + F.col(f"{v}_below")).alias(v) for v in values])
            known = materialize(known.unionByName(back))
    return known if known is not None else tree.select("node", *values).limit(0)


def _compress(active: DataFrame, values: Sequence[str], up: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Take out all nodes with one child: (what is left, the log (node, to, *values) of what went).

    In the log `to` is the first node below that has not one child, and the values are the sums from the node down to it,
    itself left out. They come by pointer doubling: in each join every open node takes over what the node it points to has.
    """
    kids = active.groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("to"), *[F.sum(u).alias(f"{u}_kid") for u in up])
    single = kids.filter("n = 1").drop("n")
    links = active.join(single, "node").select(
        "node", "parent", "to", *[(F.col(v) + F.col(f"{u}_kid")).alias(v) for v, u in zip(values, up)], *up)
    links = materialize(links)
    if links.isEmpty():
        return active, None
    ends = links.select(F.col("node").alias("to"), F.lit(False).alias("end"))
    log = links.join(ends, "to", "left").select("node", "to", *values, F.coalesce("end", F.lit(True)).alias("end"))
    log = materialize(log)
    while not log.filter("not end").isEmpty():
        step = log.select(F.col("node").alias("to"), F.col("to").alias("next"), *[F.col(v).alias(f"{v}_next") for v in values],
                          F.col("end").alias("ends"))
        moved = log.filter("not end").join(step, "to").select(
            "node", F.col("next").alias("to"), *[(F.col(v) + F.col(f"{v}_next")).alias(v) for v in values], F.col("ends").alias("end"))
        log = materialize(log.filter("end").unionByName(moved))
    log = log.drop("end")
    # The top of a chain is no node's single child; its end takes its place below its parent. The log's values have the
    # stretch right above the end in them already.
    tops = links.select("node", "parent", *up).join(links.select(F.col("to").alias("node")), "node", "left_anti")
    tops = tops.join(log, "node").select(
        F.col("to").alias("node"), F.col("parent").alias("above"), F.lit(True).alias("moved"),
        *[(F.col(v) + F.col(u)).alias(f"{u}_more") for v, u in zip(values, up)])
    left = active.join(links.select("node"), "node", "left_anti").join(tops, "node", "left")
    left = left.select(
        "node", F.when(F.col("moved"), F.col("above")).otherwise(F.col("parent")).alias("parent"), *values,
        *[F.coalesce(f"{u}_more", u).alias(u) for u in up])
    return materialize(left), log


def _rake(active: DataFrame, values: Sequence[str], up: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Take out all leaves: (what is left, with the leaves' sums added to their parents; (node, *values) of the leaves)."""
    kids = active.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.lit(True).alias("inner"))
    flagged = materialize(active.join(kids, "node", "left"))
    leaves = flagged.filter("inner is null")
    given = leaves.groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(v) + F.col(u)).alias(f"{v}_more") for v, u in zip(values, up)])
    rest = flagged.filter("inner").drop("inner").join(given, "node", "left")
    rest = rest.select("node", "parent", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values], *up)
    return materialize(rest), leaves.select("node", *values)
