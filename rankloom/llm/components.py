"""Connected components of a table of links, by union-find in the tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

LINKS = "a long, b long"


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one partition as links to the smallest member of each group that they make, by union-find.

    After every million nodes what was found is given out and the next starts anew, so memory is bounded.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def out() -> pd.DataFrame:
        pairs = [(x, find(x)) for x in list(root)]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
                root.setdefault(a, a)
        if len(root) > 1_000_000:
            yield out()
            root.clear()
    yield out()


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node that has a link, the smallest node that links lead to. Loops and repeats do no harm."""
    ship(links.sparkSession)
    now = materialise(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(forest, LINKS), "links")
    mark = None
    while True:
        now = materialise(small_star(large_star(now)), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if new == mark or not new[0]:
            break
        mark = new
    # At rest every link goes from a member to its group's smallest.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", F.col("b").alias("component")).distinct().withColumnRenamed("b", "node"))
