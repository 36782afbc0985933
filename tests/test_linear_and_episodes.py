"""Linear models against plain solvers, exact-K likelihoods against enumeration, nearest sets and band joins."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import episodes, linear, similarity


def table(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = (x @ [1.0, -0.2, 2.0] + r.normal(size=n) > -2.5).astype(int)
    return [(k, k // 8, k // 8 % 3, int(y[k]), *map(float, x[k])) for k in range(n)]


NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    data = table(600, 4)
    return data, spark.createDataFrame(data, "id long, u long, fold int, label int, a double, b double, c double").repartition(5)


def test_ridge_equals_plain_solver(rows):
    data, df = rows
    weights, prediction = linear.crossfit_ridge(df, NAMES, F.col("label") - 0.5, 3, 5.0)
    a = np.array(data)
    for f in range(3):
        x, y = a[a[:, 2] != f][:, 4:], a[a[:, 2] != f][:, 3] - 0.5
        assert np.allclose(weights[f], np.linalg.solve(x.T @ x + 5 * np.eye(3), x.T @ y), atol=1e-9)
    got = {r["id"]: r["p"] for r in df.select("id", prediction.alias("p")).collect()}
    assert all(got[k] == pytest.approx(float(a[k, 4:] @ weights[int(a[k, 2])])) for k in range(len(data)))


def gradient(x, y, sample, coefficients, strength):
    """Of the penalised loss at the given coefficients, for features standardised over these rows."""
    mean, sd = x.mean(0), x.std(0)
    w = coefficients[:-1] * sd
    b = coefficients[-1] + coefficients[:-1] @ mean
    z = (x - mean) / sd
    p = 1 / (1 + np.exp(-(z @ w + b)))
    return np.append(w - strength * (sample * (y - p)) @ z, -strength * (sample * (y - p)).sum())


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_is_at_the_optimum(rows, balanced):
    data, df = rows
    weight = 1 + F.col("id") % 3
    found = linear.logistic_fit(df, NAMES, 3, balanced=balanced, weight=weight)
    a = np.array(data)
    for f in range(3):
        own = a[a[:, 2] != f]
        y, sample = own[:, 3], 1 + own[:, 0] % 3
        if balanced:
            total, up = sample.sum(), (sample * y).sum()
            sample = sample * np.where(y > 0, total / (2 * up), total / (2 * (total - up)))
        assert np.abs(gradient(own[:, 4:], y, sample, found[f], 0.5)).max() < 1e-6


def test_pairs_within_users(spark):
    data = [(k, k // 10, 0, int(k % 10 < 6), float(k), 1.0, float(-k)) for k in range(40)] + [(100, 50, 1, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id long, u long, fold int, label int, a double, b double, c double")
    got = linear.pair_differences(df, NAMES, most=10).collect()
    want = []
    for u in range(4):
        pairs = [(p, q) for p in range(u * 10, u * 10 + 6) for q in range(u * 10 + 6, u * 10 + 10)][:10]
        want += [(u, 0, 1, float(p - q), 0.0, float(q - p)) for p, q in pairs] + [(u, 0, 0, float(q - p), -0.0, float(p - q)) for p, q in pairs]
    assert sorted(map(tuple, got)) == sorted(want)
    model = linear.logistic_fit(linear.pair_differences(df, NAMES).withColumn("fold", F.lit(1)), NAMES, 1)
    assert model.shape == (1, 4) and abs(model[0, -1]) < 1e-8 and model[0, 0] < 0 < model[0, 2]


def test_exact_k_equals_enumeration(spark):
    r = random.Random(2)
    data = {u: [(int(r.random() < 0.4), r.uniform(-3, 3) + 50 * (u % 3)) for _ in range(r.randint(1, 12))] for u in range(25)}
    df = spark.createDataFrame([(u, y, s) for u, xs in data.items() for y, s in xs], "u long, label int, s double")
    for x in episodes.exact_k_likelihood(df, "s").collect():
        xs = data[x["u"]]
        k, top = sum(y for y, _ in xs), max(s for _, s in xs)
        every = sum(math.exp(sum(s - top for s in c)) for c in itertools.combinations([s for _, s in xs], k))
        assert (x["k"], x["n"]) == (k, len(xs))
        assert x["loglik"] == pytest.approx(sum(s - top for y, s in xs if y) - math.log(every), abs=1e-9)


def test_episodes_and_shared_negatives(spark):
    train = spark.createDataFrame([(u, i) for u in range(30) for i in range(u % 7)] + [(99, i) for i in range(48)], "u long, i long")
    items = spark.range(50).select(F.col("id").alias("i"))
    got = defaultdict(list)
    for r in episodes.episodes(train, items, train, 3, "t:").collect():
        got[r["u"]].append((r["i"], r["label"]))
    assert set(got) == {u for u in range(30) if u % 7 >= 3}  # user 99 has seen all but two
    held = {tuple(r) for r in train.collect()}
    for u, xs in got.items():
        assert len(set(xs)) == 6 and sum(y for _, y in xs) == 3 and all(((u, i) in held) == bool(y) for i, y in xs)
    rows = episodes.shared_negatives(train, items, train, 4, 10, "s:").collect()
    assert not {(r["u"], r["neg"]) for r in rows} & held
    pools = defaultdict(set)
    for r in rows:
        pools[r["batch"]].add(r["neg"])
    assert len(pools) <= 4 and all(len(p) <= 10 for p in pools.values())
    for u, i, batch in {(r["u"], r["i"], r["batch"]) for r in rows}:
        assert {r["neg"] for r in rows if (r["u"], r["i"]) == (u, i)} == {n for n in pools[batch] if (u, n) not in held}


def test_nearest_users_equal_brute_force_with_few_pairs(spark):
    r = random.Random(8)
    base = {g: r.sample(range(400), r.randint(8, 25)) for g in range(15)}
    sets = {u: set(r.sample(base[u % 15], len(base[u % 15]) - 2)) | {r.randint(400, 440), 999} for u in range(150)}
    sets |= {u: set(r.sample(range(400), r.randint(1, 25))) for u in range(150, 170)}
    sets[200] = {5000}
    df = spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], "u long, i long")
    want = {}
    for u, a in sets.items():
        sims = [(-round(len(a & b) / math.sqrt(len(a)) / math.sqrt(len(b)), 9), v) for v, b in sets.items() if v != u and a & b]
        want[u] = [v for _, v in sorted(sims)[:5]]
    got = defaultdict(list)
    for x in similarity.nearest_users(df, 5).orderBy("u", "r").collect():
        got[x["u"]].append(x["v"])
    assert {u: got[u] for u in sets} == want
    pairs, _ = similarity.candidate_pairs(df, df.groupBy("u").agg(F.count(F.lit(1)).alias("n")), 5)
    every = sum(bool(a & b) for u, a in sets.items() for v, b in sets.items() if u != v)
    assert pairs.count() < 0.4 * every  # item 999 alone joins 150 users


def test_band_join_of_a_long_history(spark):
    """A user of 100,000 items: pairs follow the window, and they are the same ones as of the plain rule."""
    n = 100_000
    long = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("i"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("d"))
    got = similarity.ordered_pairs(long)
    assert got.count() == sum(n - k for k in range(1, 21))
    r = random.Random(3)
    few = [(u, i, f"2020-01-{r.randint(1, 28):02d}") for u in range(4) for i in r.sample(range(60), 45)]
    df = spark.createDataFrame(few, "u long, i long, d string").withColumn("d", F.col("d").cast("date"))
    want = defaultdict(float)
    for u in range(4):
        own = sorted((d, i) for v, i, d in few if v == u)
        for p, (d, i) in enumerate(own):
            for q in range(p + 1, min(p + 21, len(own))):
                e, j = own[q]
                want[i, j] += 0.75 ** (q - p - 1) * 0.5 ** ((int(e[-2:]) - int(d[-2:])) / 730.0)
    found = {(x["i"], x["j"]): x["w"] for x in similarity.ordered_pairs(df).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
