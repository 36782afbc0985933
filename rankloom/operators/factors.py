"""Low-rank factors of long tables by block Krylov subspaces, and the scores made of them.

Tall matrices are tables (key, v array<double>). Their orthogonal bases come from tall-skinny QR: each task reduces its rows
to a triangle, triangles merge as a tree, and the driver sees one square matrix as wide as the subspace, whatever the
number of items or users.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from rankloom.functions import vectors as V
from rankloom.operators import grid, similarity
from rankloom.session import materialise, ship

SQUARE = "part int, data binary"


def merged(parts: DataFrame, merge, width: int, fan_in: int = 64) -> np.ndarray:
    """One square matrix out of one a task (part, data): merged in groups, then those; the driver gets the last one."""

    def some(key, pdf):
        out = merge([np.frombuffer(x, "<f8").reshape(-1, width) for x in pdf.sort_values("part")["data"]])
        return pd.DataFrame({"part": [int(key[0])], "data": [np.ascontiguousarray(out, "<f8").tobytes()]})

    groups = parts.groupBy(F.floor(F.col("part") / fan_in).cast("int").alias("group")).applyInPandas(some, SQUARE)
    last = groups.groupBy(F.lit(0).alias("group")).applyInPandas(some, SQUARE).first()
    return np.zeros((0, width)) if last is None else np.frombuffer(last["data"], "<f8").reshape(-1, width)


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of the matrix whose rows are the arrays v."""
    ship(rows.sparkSession)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for pdf in batches:
            if len(pdf):
                r = np.linalg.qr(np.vstack([r, np.stack(pdf["v"].tolist())]), mode="r")
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [np.ascontiguousarray(r, "<f8").tobytes()]})

    return merged(rows.select("v").mapInPandas(reduce_rows, SQUARE), lambda xs: np.linalg.qr(np.vstack(xs), mode="r"), width)


def products(rows: DataFrame, a: str, b: str, width: int, other: int | None = None) -> np.ndarray:
    """The sum over rows of the outer products of a and b, of `width` and `other` positions (as many, if it isn't given)."""
    other = other or width

    def sum_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros((width, other))
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf[a].tolist()).T @ np.stack(pdf[b].tolist())
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [total.astype("<f8").tobytes()]})

    return merged(rows.select(a, b).mapInPandas(sum_rows, SQUARE), lambda xs: np.sum(xs, axis=0), other)


def turned(rows: DataFrame, by: np.ndarray, column: str = "v") -> DataFrame:
    """rows with their array replaced by its product with a matrix as wide as a subspace."""
    schema = rows.schema
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**{column: list(np.stack(pdf[column].tolist()) @ by)})

    return rows.mapInPandas(run, schema)


def basis_of(r: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """What turns rows with triangle r into orthonormal columns; directions that r hardly has are left out."""
    _, values, right = np.linalg.svd(r, full_matrices=False)
    keep = values > least * max(values.max(initial=0.0), 1e-300)
    return right[keep].T / values[keep]


def weight_of(cells: grid.Cells) -> str | None:
    return "w" if "w" in cells.packed.columns else None


def cells_of(rows: DataFrame) -> grid.Cells:
    """The cells of (u, i, w), or of (u, i) with weights of 1."""
    return grid.cells(rows, ("w",) if "w" in rows.columns else ())


def stepped(cells: grid.Cells, vectors: DataFrame, size: int) -> DataFrame:
    """i, v: the gram matrix of the grid's entries (u, i, w) times the matrix of vectors (i, v), over the users."""
    weight = weight_of(cells)
    return grid.product(cells, grid.product(cells, vectors, "u", size, weight), "i", size, weight)


def leading_right(rows: DataFrame | grid.Cells, k: int, steps: int = 6, more: int = 10) -> tuple[np.ndarray, DataFrame]:
    """The k leading singular values of the matrix of (u, i, w), and (i, v) with the right singular vectors.

    A block of k + more vectors, begun by a hash of the item, is multiplied by the gram matrix and made orthonormal `steps`
    times; the vectors are the best ones of the space that all blocks span together. Signs are fixed: the entry of each
    vector that is largest in size is positive. Only products with the gram matrix are written: a block is the last product
    times a small matrix, and a product the next block times another.
    """
    cells = rows if isinstance(rows, grid.Cells) else cells_of(rows)
    items = cells.packed.select(F.explode("items").alias("i")).distinct()
    size = items.count()
    if not size:
        return np.zeros(0), items.select("i", F.array().cast("array<double>").alias("v"))
    k = max(1, min(k, size - 1))
    block = min(k + more, size)
    start = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda p: F.pmod(F.xxhash64("i", p), F.lit(1 << 40)) / F.lit(float(1 << 40)) - 0.5)
    ahead = first = materialise(items.select("i", start.alias("v")), "block")
    made, turns, width = [], [], 0
    for step in range(steps + 1):
        turns.append(basis_of(triangle(ahead, ahead_width(turns, block))))
        ahead = materialise(stepped(cells, turned(ahead, turns[-1]), turns[-1].shape[1]), "stepped")
        made.append(ahead)
        width += turns[-1].shape[1]
        if width >= size:
            break
    # The blocks of the space beside each other, and the last product.
    whole = first.withColumnRenamed("v", "v0")
    for n, one in enumerate(made):
        whole = whole.join(one.withColumnRenamed("v", f"v{n + 1}"), "i")
    whole = materialise(bases(whole, turns), "subspace")
    r = triangle(whole.select("i", "v"), width)
    turn = basis_of(r, 1e-8)
    # A product with block n is block n + 1 times the inverse of what made it orthonormal.
    inner, small, at = r.T @ r, np.zeros((width, width)), np.cumsum([0, *[t.shape[1] for t in turns]])
    for n in range(1, len(turns)):
        small[:, at[n - 1] : at[n]] = inner[:, at[n] : at[n + 1]] @ np.linalg.pinv(turns[n])
    small[:, at[-2] :] = products(whole, "v", "to", width, turns[-1].shape[1])
    small = turn.T @ small @ turn
    values, ways = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:k]
    best = best[values[best] > 1e-12 * max(values.max(initial=0.0), 1e-300)]
    out = materialise(turned(whole.select("i", "v"), turn @ ways[:, best]), "right-vectors")
    return np.sqrt(values[best]), fixed_signs(out, len(best))


def ahead_width(turns: list[np.ndarray], block: int) -> int:
    return turns[-1].shape[1] if turns else block


def bases(rows: DataFrame, turns: list[np.ndarray]) -> DataFrame:
    """i, v, to: the arrays v0, v1... each turned by its matrix, beside each other, and the array that is left."""
    schema = StructType([rows.schema["i"], StructField("v", ArrayType(DoubleType())), StructField("to", ArrayType(DoubleType()))])
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                v = np.concatenate([grid.matrix(table[f"v{n}"]) @ t for n, t in enumerate(turns)], axis=1)
                yield pa.RecordBatch.from_arrays([batch["i"], grid.listed(v), batch[f"v{len(turns)}"]], names=["i", "v", "to"])

    return rows.mapInArrow(run, schema)


def fixed_signs(vectors: DataFrame, size: int) -> DataFrame:
    most = vectors.agg(*[F.max_by(F.col("v")[p], F.struct(F.round(F.abs(F.col("v")[p]), 9), F.col("i"))).alias(f"s{p}") for p in range(size)]).first()
    sign = F.array(*[F.lit(-1.0 if x is not None and x < 0 else 1.0) for x in most])
    return vectors.select("i", F.zip_with("v", sign, lambda a, b: a * b).alias("v"))


def truncated_svd(rows: DataFrame, k: int, steps: int = 6) -> tuple[DataFrame, DataFrame]:
    """(u, v) and (i, v): the k leading left and right singular vectors of the matrix of (u, i, w), each times the root of
    its singular value. Users' vectors are sums over their items."""
    cells = cells_of(rows)
    values, right = leading_right(cells, k, steps)
    by = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    times = lambda xs: F.zip_with("v", by(xs), lambda a, b: a * b).alias("v")
    items = materialise(right.select("i", times(values**0.5)), "item-factors")
    # U sqrt(s) = R V sqrt(s) / s
    users = grid.product(cells, items, "u", len(values), weight_of(cells))
    return users.select("u", times(1 / values)), items


def items_in_order(rows: DataFrame) -> DataFrame:
    """i, place: the items with numbers from 0 on."""
    from rankloom.operators import stats

    distinct = rows.select("i").distinct().withColumn("one", F.lit(1))
    return stats.prefix_sums(distinct, "i", ["one"]).select("i", F.col("one_before").alias("place"))


def svd_scores(cand: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """id, s: the rank-k approximation of the matrix of (u, i, w) at the candidates, 0 where it has no row or column."""
    users, items = truncated_svd(rows, k)
    found = cand.select("id", "u", "i").join(users.withColumnRenamed("v", "a"), "u").join(items.withColumnRenamed("v", "b"), "i").select("id", V.dot("a", "b").alias("s"))
    return cand.select("id").join(found, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))


def low_pass(cand: DataFrame, rows: DataFrame, k: int, gamma: float) -> DataFrame:
    """id, linear, pass, both: a candidate's row of R P, of R F and of R (P + gamma F), with P the gram matrix of the
    normalised matrix and F the projection on its k leading right singular vectors, between roots of the degrees."""
    n = similarity.normalised(rows)
    _, items = truncated_svd(n, k)
    # The vectors come times the root of the singular value: brought back to length 1 position by position.
    size = len(items.first()["v"])
    lengths = items.agg(*[F.sqrt(F.sum(F.col("v")[p] * F.col("v")[p])).alias(f"n{p}") for p in range(size)]).first()
    unit = F.zip_with("v", F.array(*[F.lit(float(1 / max(x, 1e-300))) for x in lengths]), lambda a, b: a * b)
    degree = rows.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    placed = materialise(items.select("i", unit.alias("v")).join(degree, "i"), "unit-factors")
    users = grid.product(grid.cells(rows, ()), placed.select("i", V.scaled("v", 1 / F.sqrt("d")).alias("v")), "u", size, None)
    near = cand.select("id", "u", "i").join(users.withColumnRenamed("v", "a"), "u").join(placed.withColumnRenamed("v", "b"), "i").select("id", (V.dot("a", "b") * F.sqrt("d")).alias("pass"))
    # R P: the gram matrix over the binary history
    linear = similarity.linear_filter(cand, rows).withColumnRenamed("s", "linear")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = cand.select("id").join(linear, "id", "left").join(near, "id", "left").select("id", zero("linear"), zero("pass"))
    return out.withColumn("both", F.col("linear") + gamma * F.col("pass"))


def community_scores(cand: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """id, log_pop, rate, blend: how often the user's community (u, community) has the candidate, by ln(1 + n), as a part
    of all that it has, and with a quarter of the item's ln(1 + popularity)."""
    own = rows.select("u", "i").join(members, "u")
    both = own.groupBy("community", "i").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("community").agg(F.count(F.lit(1)).alias("all"))
    pops = rows.groupBy("i").agg(F.count(F.lit(1)).alias("pop"))
    out = cand.select("id", "u", "i").join(members, "u", "left").join(both, ["community", "i"], "left").join(total, "community", "left").join(pops, "i", "left")
    n: Column = F.coalesce("n", F.lit(0))
    return out.select("id", F.log1p(n).alias("log_pop"), F.coalesce(n / F.col("all"), F.lit(0.0)).alias("rate"), (F.log1p(n) + 0.25 * F.log1p(F.coalesce("pop", F.lit(0)))).alias("blend"))
