"""Products of a sparse matrix with tall ones, over a grid of its entries.

Entries (u, i, w) are dealt into cells by a hash of either side. A vector goes once to each cell of its row or column, never
to each entry, and a cell gives one sum for each of its keys: what is shuffled follows the numbers of users and items times
a side of the grid, not the entries. A cell's entries are packed once, as places in lists of its users and items: a product
sends four bytes for each entry, and eight more for its weight, and compares no keys but those of the lists.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from rankloom.session import materialise, ship, shuffle_partitions

#: Entries in a row of a packed cell, and sums that are added up at a time.
ROW_ENTRIES, MOST_SUMS = 1 << 17, 200_000


class Half:
    """The sparse matrix with entries w at (t, s), 1 each without w, ready for products with blocks of columns."""

    def __init__(self, t: np.ndarray, s: np.ndarray, w: np.ndarray | None, size: int, longest: int = 1024):
        order = np.argsort(t, kind="stable")
        s, counts = s[order].astype(np.int32), np.bincount(t, minlength=size)
        w = None if w is None else w[order]
        starts = np.cumsum(counts) - counts
        self.size, self.longest, self.whole, self.long = size, longest, [], []
        # Rows with the same number of entries go together, those with very many by themselves.
        for n in np.unique(counts[counts > 0]):
            rows = np.flatnonzero(counts == n)
            if n > longest:
                self.long += [(r, s[starts[r] : starts[r] + n], np.ones(n) if w is None else w[starts[r] : starts[r] + n]) for r in rows]
            else:
                at = starts[rows][:, None] + np.arange(n)
                self.whole.append((rows, s[at], np.broadcast_to(np.ones((1, 1, n)), (len(rows), 1, n)) if w is None else w[at][:, None, :]))

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        out, width = np.zeros((self.size, v.shape[1]), v.dtype), v.shape[1]
        buffer = np.empty((max(self.longest, (1 << 19) // width), width), v.dtype)
        for rows, s, w in self.whole:
            n = s.shape[1]
            step = max(1, len(buffer) // n)
            for a in range(0, len(rows), step):
                x = buffer[: s[a : a + step].size]
                np.take(v, s[a : a + step].ravel(), axis=0, out=x, mode="clip")
                out[rows[a : a + step]] = np.matmul(w[a : a + step].astype(v.dtype), x.reshape(-1, n, width))[:, 0]
        for r, s, w in self.long:
            for a in range(0, len(s), self.longest):
                out[r] += w[a : a + self.longest].astype(v.dtype) @ v[s[a : a + self.longest]]
        return out


class Cells(NamedTuple):
    """Packed cells (bu, bi, row, users, counts, items, places, and a binary for each weight), the cells a side of the grid
    has, and how many sums the cells give for each side."""

    packed: DataFrame
    sides: int
    sums: dict[str, int]


def place(key: str, sides: int):
    return F.pmod(F.xxhash64(F.lit("grid"), key), F.lit(sides)).cast("int")


def encoded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values, and for each row the place of its own."""
    found = column.combine_chunks()
    found = (pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def packed_cell(rows: pa.Table, weights: tuple[str, ...], most: int = ROW_ENTRIES) -> pa.Table:
    """The entries of one cell in the order of users, in rows of about `most`: a row's users and how many entries each has,
    the places of the entries' items in the list of all rows' items, and the weights; null weights are NaN."""
    users, u = encoded(rows["u"])
    items, i = encoded(rows["i"])
    order = np.argsort(u, kind="stable")
    counts, i = np.bincount(u, minlength=len(users)), i[order].astype("<i4")
    ends = np.cumsum(counts)
    w = [rows[x].to_numpy().astype("<f8")[order] for x in weights]
    # Rows end with a user; the list of items is cut in as many parts.
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(most, len(i), most), "left") + 1, len(users)])
    cuts = cuts[cuts <= len(users)]
    parts = np.linspace(0, len(items), len(cuts)).astype(int)
    out = {"bu": [], "bi": [], "row": [], "users": [], "counts": [], "items": [], "places": [], **{x: [] for x in weights}}
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        at = slice(ends[a - 1] if a else 0, ends[b - 1])
        row = [rows["bu"][0].as_py(), rows["bi"][0].as_py(), n, users[a:b], counts[a:b].astype("<i4").tobytes(), items[parts[n] : parts[n + 1]], i[at].tobytes(), *[x[at].tobytes() for x in w]]
        for name, value in zip(out, row):
            out[name].append(value)
    listed = lambda xs, kind: pa.ListArray.from_arrays(np.cumsum([0, *map(len, xs)]).astype(np.int32), pa.concat_arrays(xs) if xs else pa.array([], kind))
    small = {"bu": pa.int32(), "bi": pa.int32(), "row": pa.int32()}
    return pa.table({name: listed(x, rows["ui"["users items".split().index(name)]].type) if name in ("users", "items") else pa.array(x, small.get(name, pa.binary())) for name, x in out.items()})


def cells(entries: DataFrame, weights: tuple[str, ...] = ("w",), most: int = 9_000_000, sides: int | None = None) -> Cells:
    """The entries packed in cells, written once: about `most` entries are in one at most. Entries with a null side belong to
    nobody; without weights each entry counts as 1."""
    rows = entries.where("u is not null and i is not null").select("u", "i", *[F.col(w).cast("double").alias(w) for w in weights])
    if sides is None:
        rows = materialise(rows, "entries")
        n = rows.count()
        # Up to nine cells are for the sake of cores, more only to keep a cell small: each side sends all vectors once more.
        sides = max(1, min(3, int(np.ceil((n / 250_000) ** 0.5))), int(np.ceil((n / most) ** 0.5)))
    ship(rows.sparkSession)
    number = lambda name: StructField(name, IntegerType())
    schema = StructType([number("bu"), number("bi"), number("row"), StructField("users", ArrayType(rows.schema["u"].dataType)), StructField("counts", BinaryType()), StructField("items", ArrayType(rows.schema["i"].dataType)), StructField("places", BinaryType()), *[StructField(w, BinaryType()) for w in weights]])
    dealt = rows.withColumns({"bu": place("u", sides), "bi": place("i", sides)})
    packed = materialise(dealt.groupBy("bu", "bi").applyInArrow(lambda cell: packed_cell(cell, weights), schema), "cells")
    users, items = packed.agg(F.sum(F.size("users")), F.sum(F.size("items"))).first()
    return Cells(packed, sides, {"u": users or 0, "i": items or 0})


def summed(target: np.ndarray, source: np.ndarray, weight: np.ndarray | None, vectors: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """Row t: the sum of weight * vectors[source] over the entries of target t; `step` entries are made ready at a time."""
    out = np.zeros((size, vectors.shape[1]))
    order = np.argsort(target, kind="stable")
    for a in range(0, len(order), step):
        at = order[a : a + step]
        keys = target[at]
        first, last = keys[0], keys[-1] + 1
        out[first:last] += Half(keys - first, source[at], None if weight is None else weight[at], last - first) @ vectors
    return out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def cell_product(mine: pa.Table, found: pa.Table, to: str, weight: str | None) -> pa.Table:
    """(to, v): the sums of one packed cell, with the vectors (key, v) of the other side."""
    of = "i" if to == "u" else "u"
    none = pa.table({to: pa.array([], mine["users" if to == "u" else "items"].type.value_type), "v": pa.array([], pa.list_(pa.float64()))})
    if not (len(mine) and len(found)):
        return none
    mine = mine.sort_by("row")
    flat = lambda name: pa.concat_arrays([x.flatten() for x in mine[name].chunks])
    data = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in mine[name]), kind)
    keys, counts, places = {"u": flat("users"), "i": flat("items")}, data("counts", "<i4"), data("places", "<i4")
    ends = {"u": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "i": places}
    at = pc.index_in(keys[of], value_set=found[of].combine_chunks())
    source = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)[ends[of]]
    w = None if weight is None else data(weight, "<f8")
    known = source >= 0 if w is None else (source >= 0) & ~np.isnan(w)
    target, size = ends[to], len(keys[to])
    if not known.all():
        target, source, w = target[known], source[known], None if w is None else w[known]
    out = summed(target, source, w, matrix(found["v"]), size)
    some = np.bincount(target, minlength=size) > 0
    if not some.all():
        out = out[some]
    return pa.table({to: keys[to].filter(pa.array(some)), "v": listed(out)}) if len(out) else none


def added_up(parts: pa.Table, to: str) -> pa.Table:
    """(to, v): sums of the vectors of equal keys."""
    keys, at = encoded(parts[to])
    return pa.table({to: keys, "v": listed(Half(at, np.arange(len(at)), None, len(keys)) @ matrix(parts["v"]))})


def product(cells: Cells, vectors: DataFrame, to: str, size: int, weight: str | None = "w") -> DataFrame:
    """(to, v): for each key of the side `to`, "u" or "i", the sum of weight * v over its entries, with the vectors (key, v)
    of the other side. Entries without a vector add nothing, and keys without any have no row; a null weight is none."""
    packed, sides, sums = cells
    of = "i" if to == "u" else "u"
    part = StructType([StructField(to, packed.schema["users" if to == "u" else "items"].dataType.elementType), StructField("v", ArrayType(DoubleType()))])
    there, along = (f"b{of}", f"b{to}")
    sent = vectors.where(F.col("v").isNotNull()).select(of, "v", place(of, sides).alias(there), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias(along))
    mine = packed.select("bu", "bi", "row", "users", "counts", "items", "places", *([weight] if weight else []))
    parts = mine.groupBy("bu", "bi").cogroup(sent.groupBy("bu", "bi")).applyInArrow(lambda a, b: cell_product(a, b, to, weight), part)
    if sides == 1:
        return parts
    groups = max(shuffle_partitions(packed.sparkSession), -(-sums[to] // MOST_SUMS))
    dealt = parts.groupBy(F.pmod(F.xxhash64(F.lit("sum"), to), F.lit(groups)).alias("group"))
    return dealt.applyInArrow(lambda rows: added_up(rows, to), part)
