"""Tiles of buckets that span components: how many rows, and that every pair that matters meets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import minhash


def bucket(spark, members, outliers, key=1):
    return spark.range(members + outliers).select(F.lit(key).cast("long").alias("key"), F.col("id").alias("node"), F.when(F.col("id") < members, F.lit(0)).otherwise(F.col("id")).cast("long").alias("component"), F.lit(10).cast("long").alias("n"))


def test_rows_follow_the_members(spark):
    rows = [minhash.tile_rows(bucket(spark, m, 1), 500, 10**9).count() for m in (3000, 6000, 12000)]
    assert rows[1] <= 2.2 * rows[0] and rows[2] <= 2.2 * rows[1] and rows[0] <= 2 * 3000


@pytest.mark.parametrize("seed", range(3))
def test_every_pair_of_two_components_meets_once(spark, seed):
    r = random.Random(seed)
    data = []
    for key in range(6):
        nodes = r.sample(range(1000), r.randint(2, 60))
        data += [(key, v, r.choice([0, 0, 0, 1, 2, v + 10]), r.randint(1, 9)) for v in nodes]
    data += [(9, v, c, n) for k, v, c, n in data if k == 3]  # a bucket with the same members
    got = defaultdict(list)
    for t in minhash.tile_rows(spark.createDataFrame(data, "key long, node long, component long, n long"), 7, 10**9).collect():
        got[t["tile"]].append((t["node"], t["component"], t["block"], t["crossed"]))
    met = defaultdict(int)
    for rows in got.values():
        for a, x, p, crossed in rows:
            for b, y, q, _ in rows:
                if a < b and x != y and (not crossed or p != q):
                    met[a, b] += 1
    want = defaultdict(int)
    for key in range(6):
        own = [(v, c) for k, v, c, _ in data if k == key]
        for a, x in own:
            for b, y in own:
                if a < b and x != y:
                    want[a, b] += 1
    assert met == want


def test_groups_with_an_outlier_are_exact(spark):
    """Near copies of one text and outliers at and under the bound, in tiles of few rows: components by brute force."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in r.sample(range(0, 200, 10), r.choice([1, 1, 2, 5, 6, 7])):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile=16).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: find(k) for k in range(len(texts))}
