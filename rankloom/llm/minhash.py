"""Near-duplicate documents: SuperMinHash, banding, verification on full shingle sets, grouping by union-find.

Signatures follow SuperMinHash: an element gives all hash functions values at once, r_j + j at the j-th place of a
permutation of its own, and stops as soon as no function can still fall. Documents with equal sets are one class. A
class meets others in the buckets of its bands. In a bucket each member is first held against its smallest member, and
what is linked becomes one component. Buckets that still span components are dealt in tiles of bounded size. A first
pass over the tiles keeps the members whose signature comes near that of another component's member; their texts then
join them, and a second pass counts the shared shingles of every two of different components by an inverted index of the
tile, joins what is linked by union-find and gives out only the links that merged two components. No member of a bucket
is dropped, no table of pairs is ever made, and rows follow members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, in_arrow, materialise, ship, slices
from .components import LINKS, components

BANDS, ROWS = 50, 5
U64 = np.uint64
BASE = 0x9E3779B97F4A7C55 | 1
#: The bytes that separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that are cut into words at a time; a longer word is read whole.
PART = 1 << 18
#: Elements that a call of the signature loop holds at a time.
CHUNK = 49_152
#: Members of a tile's block, and shingles of its sets; how far below the bound a signature's estimate may be, 5.8 of its
#: deviations.
TILE, VOLUME, SLACK = 2048, 4_000_000, 0.16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased. Long texts are read in parts that end between words."""
    signs = np.frombuffer(text.encode().lower(), np.uint8)
    out, begin = [], 0
    while begin < len(signs):
        end = min(begin + PART, len(signs))
        while end < len(signs):  # on to the next word's end
            gap = SPACES[signs[end : end + PART]]
            end += int(gap.argmax()) if gap.any() else len(gap)
            if gap.any():
                break
        out.append(hashes_of_words(signs[begin:end]))
        begin = end
    return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, U64)])


def hashes_of_words(signs: np.ndarray) -> np.ndarray:
    gap = SPACES[signs]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    begin, end = edge[::2], edge[1::2]
    up, down = POWERS.to(len(signs) + 1)
    sums = np.zeros(len(signs) + 1, U64)
    np.cumsum((signs.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of all its words where they are fewer; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    total = np.zeros(len(w) - size + 1, U64)
    for i in range(size):
        total = mix(total + w[i : len(w) - size + 1 + i] + U64(i + 1))
    return np.unique(total + U64(size if size < words else 0))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash values (sets x m); infinite for empty sets."""
    out = np.full((len(sets), m), np.inf)
    parts: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, s in enumerate(sets):
        for k in range(0, len(s), CHUNK):
            piece = s[k : k + CHUNK]
            if held + len(piece) > CHUNK:
                lower(out, parts)
                parts, held = [], 0
            parts.append((i, piece))
            held += len(piece)
    if parts:
        lower(out, parts)
    return out


def lower(out: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
    """Bring the elements of some sets into their signatures."""
    m, rows = out.shape[1], sorted({i for i, _ in parts})
    h = out[rows]
    at = {i: k for k, i in enumerate(rows)}
    elements = np.concatenate([s for _, s in parts])
    owner = np.repeat([at[i] for i, _ in parts], [len(s) for _, s in parts])
    places = np.empty((len(elements), m), np.int16)
    places[:] = np.arange(m, dtype=np.int16)
    flat, values = places.reshape(-1), h.reshape(-1)
    line = np.arange(len(elements)) * m
    for j in range(m):
        x = mix(elements + U64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = j + (mix(x) % U64(m - j)).astype(np.int64)
        slot = flat[line + k]
        flat[line + k] = flat[line + j]
        np.minimum.at(values, owner * m + slot, (x >> U64(11)) * 2.0**-53 + j)
        # Whatever comes later is at least j + 1.
        still = (h.max(axis=1) > j + 1)[owner]
        if not still.all():
            elements, owner, line = elements[still], owner[still], line[still]
            if not len(elements):
                break
    out[rows] = h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mix(h.view(U64)).reshape(len(h), bands, rows)
    key = np.arange(bands, dtype=U64)[None, :] * U64(0xA24BAED4963EE407)
    for r in range(rows):
        key = mix(key + bits[:, :, r])
    return key.view(np.int64)


def sign_batch(bands: int, rows: int, words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys, short = [], [], [], []
        for part in slices(batch):
            sets = [shingles(t, words) for t in part.column("text").to_pylist()]
            h = signatures(sets, bands * rows)
            sizes += [len(s) for s in sets]
            digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys += list(band_keys(h, bands, rows))
            short += [x.tobytes() for x in (mix(h.view(U64)) >> U64(56)).astype(np.uint8)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "short"])

    return run


def bucket_partition(batches):
    """From (key, node) in that order: (key, node, pivot) of the keys with several nodes; pivot: the first of them."""
    last: tuple[int, int] | None = None  # the key that the batch before ended with, and its first node
    lone = False  # whether that first node hasn't been given out
    for batch in batches:
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(key):
            continue
        went_on = last is not None and last[0] == key[0]
        if went_on and lone:
            key, node = np.append(last[0], key), np.append(last[1], node)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        pivot = np.repeat(node[at], size)
        several = np.repeat(size > 1, size)
        if went_on:
            pivot[: size[0]] = last[1]
            several[: size[0]] = size[0] > 1 or not lone
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, node, pivot)], ["key", "node", "pivot"])
        last, lone = (int(key[-1]), int(pivot[-1])), not several[-1]


TILES = "tile long, node long, component long, block int, crossed boolean"


def by_tile(each):
    """A partition function that calls each with the rows of one tile after another; the tiles come in order."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column("tile")[0].as_py() != tiles[a]:
                    yield each(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield each(pa.Table.from_batches(held))

    return run


def near_partition(percent: int, least: float):
    """From tiles in order: the members that may be similar enough to one of another component."""

    def near(tile: pa.Table) -> pa.RecordBatch:
        component, n, block = (tile.column(c).to_numpy() for c in ("component", "n", "block"))
        crossed = tile.column("crossed")[0].as_py()
        short = np.frombuffer(b"".join(tile.column("short").to_pylist()), np.uint8).reshape(len(n), -1)
        _, which, count = np.unique(component, return_inverse=True, return_counts=True)
        found = np.zeros(len(n), bool)
        # Pairs within the largest component aren't wanted: the others are held against all.
        few = np.flatnonzero(which != count.argmax())
        for k in range(0, len(few), 64):
            i = few[k : k + 64]
            fits = (which[i][:, None] != which[None, :]) & (100 * np.minimum(n[i][:, None], n[None, :]) >= percent * np.maximum(n[i][:, None], n[None, :]))
            if crossed:
                fits &= block[i][:, None] != block[None, :]
            x, y = np.nonzero(fits)
            for m in range(0, len(x), 1 << 16):
                p, q = i[x[m : m + (1 << 16)]], y[m : m + (1 << 16)]
                likely = (short[p] == short[q]).mean(axis=1) >= least
                found[p[likely]] = found[q[likely]] = True
        node = tile.column("node").to_numpy()
        at = np.flatnonzero(found)
        at = at[np.unique(node[at], return_index=True)[1]]
        kept = tile.select(["tile", "node", "component", "block", "crossed"]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)

    return by_tile(near)


def linked_pairs(node: np.ndarray, component: np.ndarray, group: np.ndarray | None, weight: np.ndarray, set_of, percent: int, volume: int):
    """Links (node, node) that merge components, of all pairs with the wanted similarity; only of two groups if given.

    set_of(i) gives the sorted shingles of row i. Rows are indexed in parts of about `volume` by their weights; each
    row's shingles are looked up in a part's index, which counts what it shares with every row of the part.
    """
    root = np.unique(component, return_inverse=True)[1]
    first = np.flatnonzero(group == group.min()) if group is not None else np.arange(len(node))
    others = np.flatnonzero(group != group.min()) if group is not None else first
    part = np.cumsum(weight[first]) // volume
    for p in np.unique(part):
        rows = first[part == p]
        sets = [set_of(i) for i in rows]
        sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(rows)), sizes)[order]
        begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        keys, end = values[begin], np.append(begin[1:], len(values))
        for i in others:
            apart = root[rows] != root[i]
            if not apart.any():
                continue
            own = set_of(i)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            at = at[keys[at] == own]
            size = end[at] - begin[at]
            where = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            both = np.bincount(owner[where], minlength=len(rows))
            for j in rows[apart & (100 * both >= percent * (len(own) + sizes - both))].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    yield int(node[i]), int(node[j])


def verify_partition(percent: int, words: int, volume: int):
    """From tiles in order, with texts: the links between components, confirmed on full sets."""

    def links(tile: pa.Table) -> pa.RecordBatch:
        node, component, block = (tile.column(c).to_numpy() for c in ("node", "component", "block"))
        data, open_up = tile.column("data").to_pylist(), zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        held = 0

        def set_of(i: int) -> np.ndarray:
            nonlocal held
            if (found := known.get(i)) is not None:
                return found
            if held > volume:
                known.clear()
                held = 0
            found = known[i] = shingles(open_up(data[i]).decode(), words)
            held += len(found)
            return found

        bytes_of = np.array([zstandard.get_frame_parameters(d).content_size for d in data])
        out = list(linked_pairs(node, component, block if tile.column("crossed")[0].as_py() else None, bytes_of / 6, set_of, percent, volume))
        return pa.RecordBatch.from_arrays([pa.array([max(x) for x in out], pa.int64()), pa.array([min(x) for x in out], pa.int64())], ["a", "b"])

    return by_tile(links)


def likely_batch(least: float):
    """Keeps pairs whose signatures agree in so large a part that the wanted similarity is possible."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("short_a", "short_b"))
        return batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return run


def pack_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts as compressed bytes, the other columns as they are."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    others = [c for c in batch.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array([squeeze(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], [*others, "data"])


def confirm_batch(percent: int, words: int):
    """Keeps pairs whose full sets have the wanted similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}
        open_up = zstandard.ZstdDecompressor().decompress
        keep = []
        for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "data_a", "data_b"))):
            if len(known) > 1000:
                known.clear()
            sets = [known[i] if i in known else known.setdefault(i, shingles(open_up(t.as_py()).decode(), words)) for i, t in ((a.as_py(), x), (b.as_py(), y))]
            both = len(np.intersect1d(*sets, assume_unique=True))
            keep.append(bool(len(sets[0])) and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def tile_rows(grouped: DataFrame, tile: int, volume: int) -> DataFrame:
    """tile, node, component, block, crossed: the rows of buckets (key, node, component, n) that span components, dealt so
    that every two members of different components meet in a tile; buckets with the same members are dealt once.

    Members of a bucket's largest component needn't meet each other. So they stand in blocks of their own, which meet the
    blocks of the other members alone, while those meet all blocks: rows follow the members as long as the others fill
    a block at most.
    """
    parts = grouped.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    order = F.struct("members", "component")
    spans = parts.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.max_by("component", order).alias("main"), F.max("members").alias("main_members"), F.max_by("n", order).alias("main_n"), F.sum("members").alias("members"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("components > 1")
    blocks = lambda members, size: F.greatest(F.ceil(F.greatest(members / tile, size / volume)), F.lit(1)).cast("int")
    spans = spans.withColumn("own", blocks(F.col("main_members"), F.col("main_n"))).withColumn("others", blocks(F.col("members") - F.col("main_members"), F.col("n") - F.col("main_n")))
    spans = spans.groupBy("members", "x", "y").agg(F.min(F.struct("key", "main", "own", "others")).alias("s")).select("s.*")
    rest = grouped.join(spans, "key").withColumn("is_main", F.col("component") == F.col("main"))
    # Blocks from 0 on are those of the others, behind them those of the largest component.
    block = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    last = F.when(F.col("is_main"), F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1)
    rest = rest.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rest.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "node", "component", "block", (F.col("block") != F.col("other")).alias("crossed"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, volume: int = VOLUME) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Null and empty texts, and white space alone, have no shingles and no links. Copies are one class and never expanded
    into pairs. Rows that share a doc_id are one document with the links of each of its texts: they have one
    component_id and are kept or not together. A null doc_id stands in no component: its component_id is null and it is
    kept. An empty table gives an empty result; other columns are ignored. A pair of exactly the wanted similarity
    shares no band with probability 1.3e-6 and is then not found; the signatures' filter misses one with less than 1e-8.
    """
    texts = docs_of(docs)
    ship(docs.sparkSession)
    signed = materialise(in_arrow(texts, sign_batch(bands, rows, words), "doc_id long, n_shingles long, digest binary, bands array<long>, short binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # An id with several texts is linked with the class of each.
    several = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    own = full.join(several, "doc_id", "left_semi").distinct().join(classes.withColumnRenamed("doc_id", "b"), "digest").select(F.col("doc_id").alias("a"), "b")
    nodes = signed.where("n_shingles > 0").join(classes, ["digest", "doc_id"], "left_semi").withColumnRenamed("doc_id", "node").withColumnRenamed("n_shingles", "n")
    dealt = nodes.select("node", F.explode("bands").alias("key")).repartition("key").sortWithinPartitions("key", "node")
    held = materialise(dealt.mapInArrow(bucket_partition, "key long, node long, pivot long"), "buckets")
    met = held.select("node").distinct()
    # Only of documents that share a bucket are signatures and texts wanted again; an id may have several of each.
    marks = materialise(nodes.select("node", "digest", "n", "short").join(met, "node", "left_semi").dropDuplicates(["node", "digest"]), "signatures")
    packed = in_arrow(texts.where("doc_id is not null"), pack_batch, "doc_id long, data binary").withColumnRenamed("doc_id", "node").join(met, "node", "left_semi")
    known = materialise(packed.groupBy("node", F.xxhash64("data").alias("h")).agg(F.first("data").alias("data")).drop("h"), "bucket-texts")
    sides = {s: marks.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("short").alias(f"short_{s}")) for s in "ab"}
    data = {s: known.select(F.col("node").alias(s), F.col("data").alias(f"data_{s}")) for s in "ab"}
    least = percent / 100 - SLACK

    # Each member against the first of its bucket: at most one pair a member.
    both = held.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct().join(sides["a"], "a").join(sides["b"], "b")
    likely = in_arrow(both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "short_a", "short_b"), likely_batch(least), LINKS).distinct()
    links = in_arrow(likely.join(data["a"], "a").join(data["b"], "b").select("a", "b", "data_a", "data_b"), confirm_batch(percent, words), LINKS)
    groups = materialise(components(links.unionByName(own)), "groups")

    # What still spans components is dealt in tiles, buckets with the same members once.
    info = marks.groupBy("node").agg(F.sum("n").alias("n")).join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    grouped = held.select("key", "node").join(info, "node")
    tiles = tile_rows(grouped, tile, volume)
    signs = tiles.join(marks.select("node", "n", "short"), "node").repartition("tile").sortWithinPartitions("tile", "node")
    near = materialise(signs.mapInArrow(near_partition(percent, least), TILES), "near")
    more = near.join(known, "node").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(verify_partition(percent, words, volume), LINKS)
    groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_class = classes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("of_class"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    # An id may be linked through another of its texts than this row's: the smallest of all its rows is of both.
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("of_class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
