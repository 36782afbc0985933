"""Totals of all subtrees of a forest by parallel tree contraction.

Rounds alternate two steps on the nodes that are left. Rake takes away every leaf: its total is known, and goes to its
parent. Compress takes away all nodes of unary chains: each finds the node below its chain by pointer jumping, in as many
joins as the longest chain's length has binary digits, and that node then hangs from what was above the chain and carries
along what the chain's nodes have themselves. What is left has leaves and branching nodes only, so each round takes at
least half of it. At the end the nodes of chains are put back: each one's total is what was found on its way down and the
total of the node below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """node and, in each of `values`, the sum over the node's subtree, itself included.

    nodes: node (any type that can be compared, unique), parent (null for a root; else a node), children long (how many
    nodes have it as parent), values long. What a step leaves is written to the shared folder, so a lost executor costs
    a step at most. Children of one node are summed before they move.
    """
    zero = F.lit(0).cast("long")
    # carry_v: what nodes between this one and its present parent have themselves.
    carries = [f"carry_{v}" for v in values]
    left = nodes.select("node", "parent", "children", *values, *[zero.alias(c) for c in carries])
    known, hung = [], []
    while True:
        left = materialise(left, "left-nodes")
        if left.isEmpty():
            break
        known.append(left.where("children = 0").select("node", *values))
        inner = raked(left, values)
        chains = inner.where("chain").select(F.col("node").alias("parent"), *[F.col(v).alias(f"of_{v}") for v in values], F.lit(True).alias("under"))
        seen = materialise(inner.join(chains, "parent", "left").withColumn("under", F.coalesce("under", F.lit(False))), "seen-nodes")
        rest = seen.where("not chain").select("node", "parent", "children", *values, *carries)
        links = seen.where("under").select(F.col("parent").alias("node"), F.col("node").alias("below"), F.col("chain").alias("going"), *[(F.col(f"of_{v}") + F.col(f"carry_{v}")).alias(v) for v in values])
        links = jumped(links, values)
        hung.append(links.select("node", "below", *values))
        tops = seen.where("chain and not under").select("node", F.col("parent").alias("above"), *carries).join(links, "node")
        tops = tops.select(F.col("below").alias("node"), "above", *[(F.col(v) + F.col(f"carry_{v}")).alias(f"more_{v}") for v in values])
        moved = [F.coalesce(f"more_{v}", f"carry_{v}").alias(f"carry_{v}") for v in values]
        left = rest.join(tops, "node", "left").select("node", F.coalesce("above", "parent").alias("parent"), "children", *values, *moved)
    if not known:
        return nodes.select("node", *values)
    ends = reduce(DataFrame.unionByName, known)
    return ends.unionByName(put_back(reduce(DataFrame.unionByName, hung), ends, values))


def raked(left: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that are no leaves, with what their leaves gave them; chain: whether one child is left, and a parent."""
    leaves = left.where("children = 0 and parent is not null")
    given = leaves.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(f"carry_{v}")).alias(f"given_{v}") for v in values])
    more = [(F.col(v) + F.coalesce(f"given_{v}", F.lit(0))).alias(v) for v in values]
    inner = left.where("children > 0").join(given, "node", "left").select("node", "parent", (F.col("children") - F.coalesce("gone", F.lit(0))).alias("children"), *more, *[f"carry_{v}" for v in values])
    return inner.withColumn("chain", (F.col("children") == 1) & F.col("parent").isNotNull())


def jumped(links: DataFrame, values: list[str]) -> DataFrame:
    """Links (node, below, going: whether below has a link itself, values) of chains, all of them down to their chain's
    lower end, with the sums of values on the way."""
    while True:
        links = materialise(links, "links")
        if links.where("going").isEmpty():
            return links
        step = links.select(F.col("node").alias("below"), F.col("below").alias("next"), F.col("going").alias("on"), *[F.col(v).alias(f"more_{v}") for v in values])
        far = links.where("going").join(step, "below").select("node", F.col("next").alias("below"), F.col("on").alias("going"), *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
        links = links.where("not going").unionByName(far)


def put_back(hung: DataFrame, ends: DataFrame, values: list[str]) -> DataFrame:
    """Totals of the nodes taken out of chains: node, below (whose total is still to be added) and what to add to it.

    What is below one chain may have stood in another one of a later round, hence a few more jumps.
    """
    mine = hung.select(F.col("node").alias("below"), F.lit(True).alias("going"))
    hung = jumped(hung.join(mine, "below", "left").withColumn("going", F.coalesce("going", F.lit(False))), values)
    last = ends.select(F.col("node").alias("below"), *[F.col(v).alias(f"more_{v}") for v in values])
    return hung.join(last, "below").select("node", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
