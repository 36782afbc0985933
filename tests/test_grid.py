"""Products over a grid of entries against plain ones, and how little they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import factors, graph, grid


@pytest.fixture(scope="module")
def entries(spark):
    rng = np.random.default_rng(3)
    dense = (rng.random((40, 30)) < 0.3) * rng.random((40, 30))
    rows = [(f"u{a}", int(b), float(dense[a, b])) for a, b in zip(*dense.nonzero())]
    return dense, spark.createDataFrame(rows + [(None, 1, 1.0)], "u string, i long, w double")


@pytest.mark.parametrize("sides", [1, 3])
def test_products_equal_plain_ones(spark, entries, sides):
    dense, rows = entries
    x = np.random.default_rng(4).normal(size=(30, 5))
    # Item 7 has no vector; an item without entries has one.
    vectors = spark.createDataFrame([(b, x[b].tolist()) for b in range(30) if b != 7] + [(99, [1.0] * 5)], "i long, v array<double>")
    cells = grid.cells(rows, sides=sides)
    x[7] = 0
    users = {r.u: np.array(r.v) for r in grid.product(cells, vectors, "u", 5).collect()}
    for a in range(40):
        assert np.allclose(users.get(f"u{a}", 0), dense[a] @ x, atol=1e-12)
    ahead = {r.i: np.array(r.v) for r in factors.stepped(cells, vectors, 5).collect()}
    for b in range(30):
        assert np.allclose(ahead.get(b, 0), (dense.T @ dense @ x)[b], atol=1e-12)


def test_a_vector_is_sent_once_to_each_cell_of_its_row(spark):
    """600 entries of 6 items meet 6 vectors a side of the grid, not 600 vectors."""
    rows = spark.range(600).select((F.col("id") % 100).alias("u"), F.floor(F.col("id") / 100).alias("i"), F.lit(1.0).alias("w"))
    vectors = spark.range(6).select(F.col("id").alias("i"), F.array_repeat(F.lit(1.0), 4).alias("v"))
    plan = factors.stepped(grid.cells(rows, sides=2), vectors, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_sums_spread_out_in_steps_are_the_same(spark):
    rng = np.random.default_rng(1)
    target, source, weight, x = rng.integers(0, 9, 500), rng.integers(0, 20, 500), rng.random(500), rng.random((20, 3))
    plain = np.zeros((9, 3))
    np.add.at(plain, target, x[source] * weight[:, None])
    for step in (1, 7, 1000):
        assert np.allclose(grid.summed(target, source, weight, x, 9, step), plain)


def test_layers_send_no_vector_for_each_edge(spark):
    rows = spark.range(60).select((F.col("id") % 10).alias("u"), F.floor(F.col("id") / 10).alias("i"), F.lit(0.5).alias("wu"), F.lit(0.25).alias("wi"))
    vectors = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    up, down = graph.layer(rows, vectors("u", 10), vectors("i", 6), 2)
    assert {tuple(r.v) for r in up.collect()} == {(7.5, 3.0)} and {tuple(r.v) for r in down.collect()} == {(11.25, 2.5)}
    assert "Join" not in up._jdf.queryExecution().optimizedPlan().toString()


def test_a_cell_is_packed_in_places_and_its_entries_carry_no_keys(spark, entries):
    """Strings and weights: four bytes for an entry's place, eight for its weight; rows end with a user and come in any order."""
    dense, rows = entries
    cells = grid.cells(rows.select("u", F.concat(F.lit("a long key of item "), "i").alias("i"), "w"), sides=2)
    stored = cells.packed.collect()
    n = int((dense > 0).sum())
    assert sum(len(r["places"]) for r in stored) == 4 * n and sum(len(r["w"]) for r in stored) == 8 * n
    assert sum(len(r["users"]) for r in stored) == cells.sums["u"] <= 2 * 40
    table = spark.createDataFrame([(f"u{a % 7}", a % 11, float(a), 0, 0) for a in range(50)], "u string, i int, w double, bu int, bi int").toArrow()
    packed = grid.packed_cell(table, ("w",), 6)
    assert len(packed) > 3 and max(len(x.as_py()) for x in packed["places"]) <= 4 * (6 + 8)
    vectors = {b: [float(b), 1.0] for b in range(11)}
    found = grid.cell_product(packed.take([3, 0, 2, 1, *range(4, len(packed))]), grid.pa.table({"i": grid.pa.array(list(vectors), "int32"), "v": list(vectors.values())}), "u", "w")
    for u, v in zip(found["u"].to_pylist(), found["v"].to_pylist()):
        assert v == [sum(float(a * (a % 11)) for a in range(50) if f"u{a % 7}" == u), sum(float(a) for a in range(50) if f"u{a % 7}" == u)]


def test_edges_of_layers_go_without_weights_and_scores_share_the_sums(spark):
    rng = np.random.default_rng(7)
    m = (rng.random((12, 9)) < 0.4).astype(float)
    m[0], m[:, 0] = 1, 1
    x, y = rng.normal(size=(12, 4)), rng.normal(size=(9, 4))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*m.nonzero())], "u long, i long")
    users, items = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], f"{key} long, v array<double>") for key, z in (("u", x), ("i", y)))
    cand = spark.createDataFrame([(12 * b + a, a, b) for a in range(12) for b in range(9)], "id long, u long, i long")
    unit = lambda z: z / np.linalg.norm(z, axis=1)[:, None]
    n = m / np.sqrt(m.sum(1))[:, None] / np.sqrt(m.sum(0))
    mean = unit(0.7 * x + 0.3 * (m @ y) / m.sum(1)[:, None]) @ unit(0.7 * y + 0.3 * (m.T @ x) / m.sum(0)[:, None]).T
    a, b = 0.7 * x + 0.3 * n @ y, 0.7 * y + 0.3 * n.T @ x
    for r in graph.aggregated_scores(cand, edges, users, items, 4, 0.3).collect():
        u, i = r["id"] % 12, r["id"] // 12
        assert np.allclose([r["mean_unit"], r["sym_unit"], r["sym"]], [mean[u, i], (unit(a) @ unit(b).T)[u, i], a[u] @ b[i]])
    assert set(grid.cells(edges, ()).packed.columns) == {"bu", "bi", "row", "users", "counts", "items", "places"}
