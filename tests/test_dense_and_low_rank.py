"""Block inverses, tall-skinny decompositions and what is made of them, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import blocks, factors


def interactions(users, items, share, seed):
    r = random.Random(seed)
    return [(u, 7 * i, float(r.randint(1, 3))) for u in range(users) for i in range(items) if r.random() < share * (2.0 if (u + i) % 3 == 0 else 0.5)]


def dense(rows):
    us, items = sorted({u for u, *_ in rows}), sorted({i for _, i, _ in rows})
    x = np.zeros((len(us), len(items)))
    for u, i, w in rows:
        x[us.index(u), items.index(i)] = w
    return us, items, x


def ease_by_numpy(rows, cand, ridge):
    us, items, x = dense(rows)
    p = np.linalg.inv(x.T @ x + ridge * np.eye(len(items)))
    b = -p / p.diagonal()[None, :]
    np.fill_diagonal(b, 0.0)
    s = x @ b
    return {c: s[us.index(u), items.index(i)] if u in us and i in items else 0.0 for c, u, i in cand}


@pytest.mark.parametrize(("items", "tile", "most"), [(300, 64, 500), (50, 64, 200_000), (129, 128, 50)])
def test_ease_equals_numpy(spark, items, tile, most, monkeypatch):
    rows = interactions(120, items, 0.1, 3)
    r = random.Random(1)
    cand = [(k, r.randint(0, 125), 7 * r.randint(0, items + 5)) for k in range(400)]
    read = blocks.weighted_entries
    monkeypatch.setattr(blocks, "weighted_entries", lambda *a: read(*a, most=most))
    got = blocks.ease(spark.createDataFrame(cand, "id long, u long, i long"), spark.createDataFrame(rows, "u long, i long, w double"), [1.0, 20.0, 300.0], tile).collect()
    assert len(got) == 3 * len(cand)
    for ridge in (1.0, 20.0, 300.0):
        want = ease_by_numpy(rows, cand, ridge)
        for x in got:
            if x["ridge"] == ridge:
                assert x["s"] == pytest.approx(want[x["id"]], abs=1e-8)


def test_inverse_tiles_are_bounded_and_exact(spark):
    n, tile = 300, 70
    a = np.random.default_rng(0).normal(size=(n, n))
    a = a @ a.T + n * np.eye(n)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(i, n)], "r long, c long, x double")
    tiles = blocks.symmetric_tiles(entries, n, tile, [0.0]).collect()
    assert len(tiles) == 25 and max(len(t["data"]) for t in tiles) <= 8 * tile * tile
    found = np.zeros((n, n))
    for t in blocks.inverse(blocks.symmetric_tiles(entries, n, tile, [0.0]), n, tile).collect():
        r, c = t["bi"] * tile, t["bj"] * tile
        found[r : r + tile, c : c + tile] = blocks.matrix(t["data"], min(tile, n - r), min(tile, n - c))
    assert np.abs(found - np.linalg.inv(a)).max() < 1e-8


def test_no_interactions(spark):
    cand = spark.createDataFrame([(1, 2, 3)], "id long, u long, i long")
    none = spark.createDataFrame([], "u long, i long, w double")
    assert [tuple(r) for r in blocks.ease(cand, none, [5.0]).collect()] == [(1, 5.0, 0.0)]
    assert [tuple(r) for r in factors.svd_scores(cand, none, 4).collect()] == [(1, 0.0)]


def test_triangle_of_many_parts(spark):
    a = np.random.default_rng(2).normal(size=(500, 6))
    df = spark.createDataFrame([(x.tolist(),) for x in a], "v array<double>").repartition(9)
    r = factors.triangle(df, 6)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, a.T @ a)


@pytest.mark.parametrize(("users", "items", "k"), [(80, 60, 8), (40, 90, 16), (12, 5, 16)])
def test_svd_scores_equal_numpy(spark, users, items, k):
    rows = interactions(users, items, 0.2, 5)
    us, ids, x = dense(rows)
    a, s, b = np.linalg.svd(x, full_matrices=False)
    k = min(k, len(ids) - 1)
    want = (a[:, :k] * s[:k]) @ b[:k]
    cand = [(n, us[n % len(us)], ids[(3 * n) % len(ids)]) for n in range(300)]
    got = factors.svd_scores(spark.createDataFrame(cand, "id long, u long, i long"), spark.createDataFrame(rows, "u long, i long, w double"), k).collect()
    for x in got:
        _, u, i = cand[x["id"]]
        assert x["s"] == pytest.approx(want[us.index(u), ids.index(i)], abs=1e-6)
    values, right = factors.leading_right(spark.createDataFrame(rows, "u long, i long, w double"), k)
    assert np.allclose(values, s[: len(values)], atol=1e-6)
    found = np.array([r["v"] for r in right.orderBy("i").collect()])
    assert np.allclose(found.T @ found, np.eye(found.shape[1]), atol=1e-6)
    assert all(found[np.abs(found[:, p]).argmax(), p] > 0 for p in range(found.shape[1]))
