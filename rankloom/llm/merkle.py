"""Merkle manifests of a dataset, in blocks whose nodes lie in van Emde Boas order.

The leaves of a tree are numbered in order over all tasks. An aligned run of arity^height of them is a block: one task
builds the subtree above it and stores all its nodes in one row, the upper half of the levels first, then each subtree of
the lower half, and so on within each, so that the place of any node, parent or sibling follows from (depth, index) by
arithmetic alone. The roots of the blocks are the leaves of the next, smaller level of blocks, until one block is left.
Proofs come down the same way: each block hands to the blocks below what stands beside them, and the lowest blocks read a
leaf's siblings by address and join them to what came from above. No task sees more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .ordered import in_ranges, running

#: Children of a node; levels of a block above its leaves.
ARITY, HEIGHT = 16, 3
#: Signs of a digest as hex text.
HEX = 64

BLOCKS = "tree string, block long, leaves int, nodes binary, top binary"
SIDES = "array<struct<left: string, right: string>>"


@lru_cache(maxsize=64)
def nodes_in(arity: int, levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return sum(arity**d for d in range(levels))


def address(depth: int, index: np.ndarray, levels: int, arity: int = ARITY) -> np.ndarray:
    """Where the nodes of this depth (0: the root) and these indexes lie in a complete tree of so many levels.

    The upper half of the levels comes first, as a tree laid out by the same rule; behind it, in order, the trees below it.
    """
    index, base = np.asarray(index, np.int64), np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, width = levels - upper, arity ** (depth - upper)
        base += nodes_in(arity, upper) + index // width * nodes_in(arity, lower)
        index, depth, levels = index % width, depth - upper, lower
    return base


def height_of(leaves: int, arity: int) -> int:
    """Levels above the leaves of a tree of its own: as long as there are several nodes, runs of them become one."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // arity), height + 1
    return height


class Block:
    """The nodes of an aligned subtree, digests of 32 bytes each at its address; places beyond the last leaf stay empty."""

    def __init__(self, leaves: int, height: int, arity: int, nodes: bytes | None = None):
        self.leaves, self.height, self.arity = leaves, height, arity
        size = nodes_in(arity, height + 1)
        self.nodes = np.zeros((size, 32), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(size, 32)

    def width(self, level: int) -> int:
        """Nodes that are there, `level` levels above the leaves."""
        return -(-self.leaves // self.arity**level)

    def places(self, level: int) -> np.ndarray:
        return address(self.height - level, np.arange(self.width(level)), self.height + 1, self.arity)

    def hex(self, level: int) -> str:
        return self.nodes[self.places(level)].tobytes().hex()

    def build(self, digests: list[bytes]) -> Block:
        self.nodes[self.places(0)] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        for level in range(1, self.height + 1):
            below, run = self.hex(level - 1).encode(), HEX * self.arity
            made = b"".join(sha256(below[a : a + run]).digest() for a in range(0, len(below), run))
            self.nodes[self.places(level)] = np.frombuffer(made, np.uint8).reshape(-1, 32)
        return self

    def sides(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf, what stands left and right of its way to the block's root, from below."""
        text, run = [self.hex(level) for level in range(self.height)], HEX * self.arity
        for i in range(self.leaves):
            out = []
            for level in range(self.height):
                k = i // self.arity**level
                start = k // self.arity * run
                out.append((text[level][start : k * HEX], text[level][(k + 1) * HEX : start + run]))
            yield out


def block_height(block: int, leaves: int, height: int, arity: int) -> int:
    """Only a tree's first block can be its only one; it is then as high as its leaves need, and else full."""
    return height if block else height_of(leaves, arity)


def build_block(key: tuple, pdf: pd.DataFrame, height: int, arity: int) -> pd.DataFrame:
    tree, number = key
    pdf = pdf.sort_values("at", kind="stable")
    digests = [d for d, n in zip(pdf["digest"], pdf["n"]) for _ in range(n)]
    block = Block(len(digests), block_height(number, len(digests), height, arity), arity).build(digests)
    return pd.DataFrame({"tree": [tree], "block": [number], "leaves": [block.leaves], "nodes": [block.nodes.tobytes()], "top": [block.nodes[0].tobytes()]})


def numbered(leaves: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """Runs of equal leaves (tree, n and others) cut at the bounds of blocks: tree, block, at (in the block), n, others."""
    rows = running(in_ranges(leaves, "tree", order, name), "tree", order, F.col("n"), "end").drop("part")
    first, last = F.col("end") - F.col("n"), F.col("end") - 1
    rows = rows.withColumn("first", first).withColumn("block", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
    at = F.greatest(F.col("first"), F.col("block") * size)
    rows = rows.withColumn("at", (at - F.col("block") * size).cast("int")).withColumn("n", (F.least(F.col("end"), (F.col("block") + 1) * size) - at).cast("int"))
    return materialise(rows.drop("first", "end"), f"{name}-in-blocks")


class Forest:
    """The blocks over numbered leaves, lowest first, and the top digest of each tree."""

    def __init__(self, rows: DataFrame, height: int, arity: int):
        ship(rows.sparkSession)
        self.height, self.arity, self.levels = height, arity, []
        size, tops = arity**height, []
        rows = rows.select("tree", "block", "at", "n", "digest")

        def build(key, pdf):
            return build_block(key, pdf, height, arity)

        while True:
            blocks = materialise(rows.groupBy("tree", "block").applyInPandas(build, BLOCKS), "blocks")
            self.levels.append(blocks)
            several = blocks.where("block > 0").select("tree").distinct()
            tops.append(blocks.where("block = 0").join(several, "tree", "left_anti").select("tree", F.col("top").alias("digest")))
            if several.isEmpty():
                break
            place = F.col("block")
            rows = blocks.join(several, "tree", "left_semi").select("tree", F.floor(place / size).alias("block"), (place % size).cast("int").alias("at"), F.lit(1).alias("n"), F.col("top").alias("digest"))
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def sides(self, above: DataFrame) -> DataFrame:
        """tree, block, sides: what stands beside the way from each of the lowest blocks to the root, from below.

        above: tree, sides for the top of each tree.
        """
        top = above.select("tree", F.lit(0).cast("long").alias("block"), "sides")
        known = None
        for blocks in reversed(self.levels):
            # A tree's highest block takes what stands beside its top; lower ones what the block above them gave.
            if known is None:
                known = top
            else:
                known = known.unionByName(top.join(known.select("tree").distinct(), "tree", "left_anti"))
            if blocks is self.levels[0]:
                return known
            known = materialise(hand_down(blocks, known, self.height, self.arity), "sides")
        raise AssertionError


def hand_down(blocks: DataFrame, known: DataFrame, height: int, arity: int) -> DataFrame:
    """tree, block, sides: what each leaf of these blocks, as a block of the level below, has beside its way to the root.

    known: tree, block, sides of these blocks.
    """

    def run(batches):
        yield from each_below(batches, arity**height, height, arity)

    return blocks.select("tree", "block", "leaves", "nodes").join(known, ["tree", "block"]).mapInPandas(run, f"tree string, block long, sides {SIDES}")


def each_below(batches: Iterator[pd.DataFrame], size: int, height: int, arity: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for tree, number, leaves, nodes, sides in pdf[["tree", "block", "leaves", "nodes", "sides"]].itertuples(index=False):
            block = Block(leaves, block_height(number, leaves, height, arity), arity, nodes)
            up = [(s["left"], s["right"]) for s in sides]
            yield pd.DataFrame({"tree": tree, "block": [number * size + i for i in range(leaves)], "sides": [[{"left": a, "right": b} for a, b in [*own, *up]] for own in block.sides()]})


def fold(leaf: str, sides: list[tuple[str, str]]) -> str:
    for left, right in sides:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


PROOFS = "leaf string, subroot string, proof_sha256 string, folded_root string"


def prove_block(key: tuple, rows: pd.DataFrame, blocks: pd.DataFrame, height: int, arity: int) -> pd.DataFrame:
    """Proof and folded root of each row of one of the lowest blocks."""
    found = blocks.iloc[0]
    block = Block(found["leaves"], block_height(key[1], found["leaves"], height, arity), arity, found["nodes"])
    up = [(s["left"], s["right"]) for s in found["sides"]]
    above = "".join(a + b for a, b in up).encode()
    ways, out = list(block.sides()), []
    for r in rows.to_dict("records"):
        leaf = r["digest"].hex()
        start = r["altered"].hex() if r["altered"] is not None else leaf
        for i in range(r["at"], r["at"] + r["n"]):
            proof = sha256("".join(a + b for a, b in ways[i]).encode())
            proof.update(above)
            out.append((r["id"], leaf, found["subroot"].hex(), proof.hexdigest(), fold(start, [*ways[i], *up])))
    return pd.DataFrame(out, columns=["id", "leaf", "subroot", "proof_sha256", "folded_root"])


def record(columns: list[Column]) -> Column:
    """Fields as one text: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def prove(leaves: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each of the leaves.

    leaves: id long, tree string (not null; trees are ordered bytewise), digest binary, altered binary (null: as it was).
    Leaves of a tree are ordered by id, null first, then by digest; equal rows are leaves of their own beside each other.
    An empty table gives an empty result. A block's task holds arity^height leaves.
    """
    size, order = arity**height, ["id", "digest", "altered"]
    whole = materialise(leaves.groupBy("tree", *order).agg(F.count(F.lit(1)).alias("n")), "leaves")
    rows = numbered(whole, order, size, "leaves")
    forest = Forest(rows, height, arity)
    tops = materialise(forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(1).alias("n")), "subroots")
    over = numbered(tops, ["name"], size, "subroots")
    crown = Forest(over, height, arity)
    root = crown.tops.first()
    if root is None:
        return leaves.sparkSession.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # Down again: beside the root stands nothing, beside each tree's top what the trees' own tree has.
    nothing = F.array().cast(SIDES)
    under = crown.sides(crown.tops.select("tree", nothing.alias("sides")))
    given = hand_down(crown.levels[0], under, height, arity)
    names = over.select(F.col("name").alias("tree"), (F.col("block") * size + F.col("at")).alias("place"), F.col("digest").alias("subroot"))
    above = materialise(names.join(given.select(F.col("block").alias("place"), "sides"), "place").drop("place"), "above")
    beside = forest.sides(above).join(above.select("tree", "subroot"), "tree")
    lowest = forest.levels[0].select("tree", "block", "leaves", "nodes").join(beside, ["tree", "block"])

    def proofs(key, rows, blocks):
        return prove_block(key, rows, blocks, height, arity)

    # Ids go through Python as texts: numbers with nulls among them would come as floating point ones.
    rows = rows.withColumn("id", F.col("id").cast("string"))
    proved = rows.groupBy("tree", "block").cogroup(lowest.groupBy("tree", "block")).applyInPandas(proofs, f"id string, {PROOFS}")
    root = bytes(root["digest"]).hex()
    return proved.select(F.col("id").cast("long").alias("id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of a table of documents: its rows' records, and those of texts in lower case for one id in five."""
    fields = lambda text: record([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    text = F.col("text")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (lower != text)
    digest = lambda t: F.unhex(F.sha2(fields(t), 256))
    tree = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    return docs.select(F.col("doc_id").alias("id"), tree.alias("tree"), digest(text).alias("digest"), F.when(tampered, digest(lower)).alias("altered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of documents.

    Sources are trees, a null source before all others; nulls in any column are part of the record; rows that share an id
    or are repeated are leaves of their own, ordered by their digests; other columns are ignored. Where 5 divides the CRC-32 of the id, the folded root is that of the text with A to Z in lower case, so the check
    fails where the text has such a letter; a null id is never altered.
    """
    return prove(document_leaves(docs)).withColumnRenamed("id", "doc_id")
