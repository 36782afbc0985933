"""The trie of conversations' beginnings.

A node is a distinct sequence of first turns. A turn is known by a digest of role and text, a sequence by two 64-bit
lanes: the exclusive or, over its turns, of hashes of place and digest. Lanes of all beginnings of a conversation are a
running fold over its turns, so no level waits for the one before it and no conversation is gathered. Nodes are groups of
equal lanes; totals of subtrees come from tree_sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, shuffle_partitions
from .ordered import in_ranges, running
from .tree_sums import subtree_totals

#: Conversations of one family begin like its first; at most this many turns are taken over.
FAMILY, MOST = 5, 8
ENDS_OF_NONE = sha256(b"").hexdigest()
#: Ids of a text that one task hands to the next.
CHUNK = 8192


def taken_over(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST + 1)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text), bytes (of the text), for every turn with a conv_id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text("text")).cast("long").alias("bytes"))
    order = ["turn", "digest"]
    return running(in_ranges(turns, "conv_id", order, "turns"), "conv_id", order, F.lit(1).cast("long"), "place").select("conv_id", "place", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their turns (conv_id, place, digest, bytes) with beginnings taken over."""
    head = turns.where(F.col("place") <= MOST)
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    convs = lengths.select("conv_id", taken_over(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    firsts = lengths.select(F.col("conv_id").alias("first"), "turns")
    convs = materialise(convs.join(firsts, "first", "left").select("conv_id", "h", "first", F.least("h", F.coalesce("turns", F.lit(0))).alias("got")), "families")
    begun = convs.where("got > 0").join(head.withColumnRenamed("conv_id", "first"), "first").where("place <= got").select("conv_id", "place", "digest", "bytes")
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("place"), "digest", "bytes")
    return convs.select("conv_id"), begun.unionByName(own)


def lane(k: int) -> Column:
    return F.xxhash64(F.lit(k), "place", "digest")


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, place, bytes, node and parent (place and lanes) for each beginning of each conversation but the empty one."""
    rows = in_ranges(turns, "conv_id", ["place"], "rebuilt-turns")
    for k in (0, 1):
        rows = running(rows, "conv_id", ["place"], lane(k), f"lane{k}", F.bit_xor)
    return rows.select("conv_id", "place", "bytes", key(F.col("place"), F.col("lane0"), F.col("lane1")).alias("node"), key(F.col("place") - 1, F.col("lane0").bitwiseXOR(lane(0)), F.col("lane1").bitwiseXOR(lane(1))).alias("parent"))


def key(place: Column, first: Column, second: Column) -> Column:
    return F.struct(place.alias("depth"), first.alias("a"), second.alias("b"))


def root_key() -> Column:
    zero = F.lit(0).cast("long")
    return key(zero, zero, zero)


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conv_id) as comma-joined texts of at most CHUNK ids, with the first of each."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [node[0]], "head": [node[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for *now, conv_id in zip(*[batch.column(c).to_pylist() for c in ("depth", "head", "conv_id")]):
            if ids and (now != node or len(ids) >= CHUNK):
                yield out()
                ids = []
            node = now
            ids.append(conv_id)
    if ids:
        yield out()


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by (node, first) as one digest for each node; the task holds one text and the digest's state."""
    node, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [node[0]], "head": [node[1]], "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for *now, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "head", "ids")]):
            if now != node:
                if state is not None:
                    yield out()
                node, state = now, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield out()


def ends(where: DataFrame) -> DataFrame:
    """depth, head, ends_sha256 of the nodes (depth, head) at which conversations end: where has depth, head, conv_id.

    SHA-256 must read a node's ids one after another. They are sorted and joined to texts by ranges, over all tasks; then
    one task for each node reads those texts as a stream, 1 row for 8192 conversations.
    """
    ship(where.sparkSession)
    # A lot of nodes have one end, for which no task of Python is needed.
    one = where.groupBy("depth", "head").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    one = materialise(one, "ends")
    single = one.where("n = 1").select("depth", "head", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = where.join(one.where("n > 1").select("depth", "head"), ["depth", "head"], "left_semi")
    order, parts = ["depth", "head", "conv_id"], shuffle_partitions(where.sparkSession)
    texts = many.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(chunk_batches, "depth long, head long, first long, ids string")
    texts = texts.repartition(parts, "depth", "head").sortWithinPartitions("depth", "head", "first")
    return single.unionByName(texts.mapInArrow(digest_batches, "depth long, head long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie of
    rebuilt conversations (see rebuilt()).

    A node's conv_id is its smallest member, and with the depth it names the node. Turns are ordered by turn, null first;
    turns of one number by a digest of their content, so equal ones side by side. The first of a negative id's family is
    the nearest multiple of five towards zero. Null roles and texts are empty ones; rows
    without conv_id belong to no conversation; a conversation with nothing left is a member of the root alone; a table
    without conversations has no nodes; other columns are ignored.
    """
    convs, turns = rebuilt(materialise(turns_in_order(conversations), "ordered-turns"))
    rows = materialise(beginnings(turns), "beginnings")
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.first("parent").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    least = root.first()["conv_id"]
    nodes = nodes.unionByName(root.where("n_convs > 0").select(root_key().alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("struct<depth: long, a: long, b: long>").alias("parent")))
    by_key = nodes = materialise(nodes, "nodes")
    # From here on a node is (depth, smallest member), and its children are counted.
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    fans = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    nodes = nodes.join(fans, "node", "left").join(up, "parent", "left").select(F.col("node.depth").alias("depth"), "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes")
    nodes = materialise(nodes, "named-nodes")
    named = lambda depth, head: F.struct(depth.alias("depth"), head.alias("head"))
    parent = F.when(F.col("depth") > 0, named(F.col("depth") - 1, F.col("parent_conv_id")))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    totals = subtree_totals(nodes.select(named(F.col("depth"), F.col("conv_id")).alias("node"), parent.alias("parent"), F.col("n_children").alias("children"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    totals = totals.select("node.depth", F.col("node.head").alias("conv_id"), "n_leaves", "saved_tokens")
    # Where conversations end: at their last beginning, whose node is found by its key, or at the root.
    last = rows.groupBy("conv_id").agg(F.max("place").alias("place"))
    member = rows.select("conv_id", "place", "node").join(last, ["conv_id", "place"])
    ended = member.join(by_key.select("node", F.col("conv_id").alias("head")), "node").select(F.col("place").alias("depth"), "head", "conv_id")
    at_root = convs.join(last, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("head"), "conv_id")
    found = ends(materialise(ended.unionByName(at_root), "ended")).withColumnRenamed("head", "conv_id")
    out = nodes.join(totals, ["depth", "conv_id"]).join(found, ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ENDS_OF_NONE)).alias("ends_sha256"))
