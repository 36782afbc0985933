"""Exact top-k against brute force."""

import random

from pyspark.sql import functions as F

from rankloom.llm import topk


def test_topk_matches_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.5, 0.5]), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rank", F.lit(2))
    vectors = topk.quantised(df)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=7, shard_rows=40, tile_rows=4, fan_in=2).collect()}
    ints = {i: [int(64 * x // 1) for x in e] for i, e in rows[:300]}
    want = {}
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_large_values_stay_exact_and_empty_tables_work(spark):
    big = [(i, [2.0**21 + i, 2.0**21, -(2.0**20)]) for i in range(25)]
    vectors = topk.quantised(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    rows = topk.top_k(vectors, vectors.where("vec_id = 0"), k=30).collect()
    ints = {i: [int(64 * x) for x in e] for i, e in big}
    assert [(x.vec_id, x.score) for x in sorted(rows, key=lambda x: x.rank)] == [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(ints[0], v)), i) for i, v in ints.items() if i)]
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0


def test_scores_beyond_64_bits_are_errors_and_those_just_inside_are_exact(spark):
    import pytest

    big = 2**31
    df = spark.createDataFrame([(0, [big, 1 - big]), (1, [big, big]), (2, [-big, big - 1])], "vec_id long, vector array<long>")
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df.where("vec_id = 0")).collect()}
    assert found == {(0, 1): 2**31, (0, 2): -(2**62) - (2**31 - 1) ** 2}
    over = spark.createDataFrame([(0, [2**33]), (1, [2**33])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="too large|OverflowError"):
        topk.top_k(over, over).collect()
