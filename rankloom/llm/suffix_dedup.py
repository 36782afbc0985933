"""Removal of byte strings that occur earlier, by interval expansion on Burrows-Wheeler transforms.

Strings of `length` bytes that are equal must meet in one place before a transform can show that they are. So each
start of such a string is tied to an anchor, the smallest hash of the 24-grams inside it (the rightmost of equal ones):
equal strings have equal anchors. An anchor's context are the bytes that its strings cover. Anchors meet by their hash,
with a digest of 128 bits of the context. Where one hash has equal contexts only, the first in the corpus stays and the others are
marked whole. Where it has several, one document's bytes for each go to the task of the hash; there the suffixes of many
contexts are sorted as far as needed, and a breadth-first backward extension on their transform finds the common
prefixes of neighbours by increasing value and stops at `length`: neighbours without a value share a string. Of each
such group the first in the corpus stays, the others are marked.

Equal contexts of one batch shrink to their first before they are shuffled, and groups are read as sorted streams.
Contexts of one hash that are too many for a task's memory are resolved by the digests of their strings in a distributed
aggregation. Texts cross the network compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise, ship, slices
from .minhash import POWERS, U64, Powers, mix

GRAM = 24
#: Bytes of a document that are anchored at a time, and of contexts that are sorted at a time.
SEGMENT, BLOCK = 1 << 18, 1 << 18
#: Bytes of distinct contexts of one hash that a task holds.
MOST = 1 << 23
NO_ID = -(1 << 63)
#: Powers of a second digest.
OTHERS = Powers(0xD1B54A32D192ED03)


def anchors(data: bytes, length: int) -> np.ndarray:
    """Rows of (hash, context's two digests, first start, number of starts), one for each anchor of a text."""
    out: list[np.ndarray] = []
    window = length - GRAM + 1
    for base in range(0, len(data) - length + 1, SEGMENT):
        signs = np.frombuffer(data, np.uint8, min(SEGMENT + length - 1, len(data) - base), base)
        up, down = POWERS.to(len(signs) + 1)
        sums = np.zeros(len(signs) + 1, U64)
        np.cumsum((signs.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(signs) - GRAM + 1])
        # 40 bits of hash, then a number that falls with the position: the rightmost of equal ones is the smallest.
        least = (h & U64(0xFFFFFFFFFF000000)) | (U64(0xFFFFFF) - np.arange(len(h), dtype=U64))
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        at = (U64(0xFFFFFF) - (least & U64(0xFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((first, [len(at)])))
        key = (h[at[first]] >> U64(16)).astype(np.int64)
        digests = []
        for powers in (POWERS, OTHERS):
            if digests:
                up, down = powers.to(len(signs) + 1)
                np.cumsum((signs.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
            digests.append(mix((sums[first + count + length - 1] - sums[first]) * down[first] + count.astype(U64) * U64(0xD6E8FEB86659FD93)).view(np.int64))
        out.append(np.stack([key, *digests, first + base, count], 1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


ANCHORS = "key long, h long, c long, d long, doc_id long, first long, n int"
MARKS = "h long, doc_id long, first long, n int"
CONTEXTS = f"{MARKS}, context binary"


def arrow(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = columns or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def anchor_batch(length: int):
    """The anchors of a batch, to be dealt by `key`: the hash, or for later ones of equal contexts, which are marks
    already and have no hash, a hash of their place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for part in slices(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                rows = anchors(text.encode(), length)
                found.append(np.column_stack([rows, np.full(len(rows), doc_id, np.int64)]))
        h, c, d, first, n, doc_id = np.concatenate(found).T
        order = np.lexsort((first, doc_id, d, c, h))
        h, c, d, first, n, doc_id = (x[order] for x in (h, c, d, first, n, doc_id))
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])))
        again = same & np.concatenate(([False], (doc_id[1:] == doc_id[:-1]) & (first[1:] == first[:-1])))
        h, c, d, first, n, doc_id, same = (x[~again] for x in (h, c, d, first, n, doc_id, same))  # repeated rows stand at one place
        key = np.where(same, (mix(doc_id.astype(U64) * U64(31) + first.astype(U64)) >> U64(16)).astype(np.int64), h)
        out = pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(x, mask=same) for x in (h, c, d)], pa.array(doc_id), pa.array(first), pa.array(n.astype(np.int32))], ["key", "h", "c", "d", "doc_id", "first", "n"])
        return out

    return run


def settle_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in the order of (h, c, d, doc_id, first): marks (h null), and the first of each context where a hash
    has several (with h). Works on neighbours only, so memory doesn't grow with a hash's rows."""
    last: dict[str, np.ndarray] | None = None  # the last first-of-context row, not yet given out
    given = False  # whether the present hash is known to have several contexts
    columns = ("doc_id", "first", "n")
    for batch in batches:
        marked = batch.filter(pc.is_null(batch.column("h")))
        if marked.num_rows:
            yield pa.RecordBatch.from_arrays([marked.column(x) for x in ("h", *columns)], ["h", *columns])
        rest = batch.filter(pc.is_valid(batch.column("h")))
        if not rest.num_rows:
            continue
        now = {x: rest.column(x).to_numpy() for x in ("h", "c", "d", *columns)}
        if last is not None:
            now = {x: np.concatenate((last[x], now[x])) for x in now}
        again = np.concatenate(([False], np.all([now[x][1:] == now[x][:-1] for x in ("h", "c", "d", "doc_id", "first")], axis=0)))
        now = {x: v[~again] for x, v in now.items()}
        h, c, d = now["h"], now["c"], now["d"]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, new_c)[group] > 1
        if given:
            several |= group == 0
        fresh = np.ones(len(h), bool)
        if last is not None:
            fresh[0] = not given  # given out before, if its hash was known to have several contexts
        # The last context goes on in the next batch; its first row is held for comparison.
        tail = int(np.flatnonzero(new_c)[-1])
        wanted = new_c & several & fresh
        keep = ~new_c | wanted
        out_h = pa.array(h[keep], mask=~new_c[keep])
        held_given = bool(several[tail])
        if keep.any():
            yield pa.RecordBatch.from_arrays([out_h, *[pa.array(now[x][keep]) for x in columns]], ["h", *columns])
        last, given = {x: now[x][tail : tail + 1] for x in now}, held_given


def pack_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts as compressed bytes, the other columns as they are."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    data = pa.array([squeeze(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
    others = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], data], [*others, "data"])


def context_batch(length: int):
    """The bytes of the wanted contexts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, open_up = [], zstandard.ZstdDecompressor().decompress
        for doc_id, packed, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "starts"))):
            data = open_up(packed)
            out += [(s["h"], doc_id, s["first"], s["n"], data[s["first"] : s["first"] + s["n"] + length - 1]) for s in starts]
        return arrow(list(zip(*out)), CONTEXTS)

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text of numbers under 512 in the order of the strings that begin there, by `depth` signs at least."""
    n = len(text)
    key = np.zeros(n, U64)
    padded = np.concatenate([text, np.zeros(7, text.dtype)])
    for i in range(7):
        key = (key << U64(9)) | padded[i : i + n].astype(U64)
    known = 7
    while True:
        order = np.argsort(key)
        step = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (step[1:] != step[:-1]).astype(np.int64))))
        if known >= depth or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - known] = rank[known:]
        key = ((rank << 32) | after).astype(U64)
        known *= 2


def shared_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours i - 1 and i in the order, whether they share `length` bytes.

    Level l holds the intervals of strings of l bytes. Extending one to the left by each byte of its transform gives
    intervals of l + 1 bytes; where such an interval ends, the common prefix of the neighbours is l, if it has none yet.
    """
    n = len(text)
    last = text[order - 1]  # the transform; before the first sign stands the last, the end sign
    by_byte = np.argsort(last.astype(np.uint16), kind="stable")
    jump = np.empty(n, np.int64)
    jump[by_byte] = np.arange(n)
    is_open = np.ones(n + 1, bool)
    is_open[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        one = size == 1
        new_lo, new_hi = [jump[lo[one]]], [jump[lo[one]] + 1]
        lo, size = lo[~one], size[~one]
        if len(lo):
            total = np.cumsum(size)
            where = np.repeat(lo - (total - size), size) + np.arange(total[-1])
            key = np.repeat(np.arange(len(lo)), size) * 512 + last[where]
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            new_lo.append(jump[where[at]])
            new_hi.append(new_lo[-1] + count)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = is_open[hi]
        lo, hi = lo[fresh], hi[fresh]
        is_open[hi] = False
        if not len(lo):
            break
    return is_open[:n]


def repeats(contexts: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(doc_id, first, n): starts, in contexts (doc_id, first, n, bytes), of strings that begin earlier in another."""
    # Bytes as 1 to 256, and 0 for the end of all.
    text = np.append(np.frombuffer(b"".join(c[3] for c in contexts), np.uint8).astype(np.int64) + 1, 0)
    sizes = np.array([len(c[3]) for c in contexts])
    starts = np.array([*(c[2] for c in contexts), 0])
    begin = np.cumsum(sizes) - sizes
    order = suffix_order(text, length)
    group = np.cumsum(~shared_prefixes(text, order, length)) - 1
    # Contexts in the corpus's order, and the positions at which one of their strings begins.
    place = np.zeros(len(contexts) + 1, np.int64)
    place[sorted(range(len(contexts)), key=lambda i: contexts[i][:2])] = np.arange(len(contexts))
    owner = np.repeat(np.arange(len(contexts) + 1), [*sizes, 1])
    offset = np.arange(len(text)) - np.append(begin, 0)[owner]
    rank = np.where(offset < starts[owner], place[owner] * np.int64(1 << 32) + offset, np.iinfo(np.int64).max)[order]
    least = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    marked = np.sort(order[(rank > least[group]) & (rank != np.iinfo(np.int64).max)])
    if not len(marked):
        return []
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(marked) != 1) | (owner[marked[1:]] != owner[marked[:-1]]))))
    count = np.diff(np.concatenate((cut, [len(marked)])))
    return [(contexts[o][0], contexts[o][1] + f, k) for o, f, k in zip(owner[marked[cut]].tolist(), offset[marked[cut]].tolist(), count.tolist())]


def resolve_partition(length: int):
    """Marks of the contexts of a partition, which come in the order of (h, doc_id, first); those of a hash with more
    than MOST bytes of distinct contexts are given back with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block: list[tuple[int, int, int, bytes]] = []
        held = 0
        own: list[tuple[int, int, int, bytes]] = []
        seen: set[bytes] = set()
        now, size, over = None, 0, False

        def close_hash() -> None:
            nonlocal block, held, own, seen
            if len(own) > 1 and not over:
                block += own
                held += size
            own, seen = [], set()

        def close_block() -> None:
            nonlocal block, held, out
            if block:
                out += [(None, d, f, n, None) for d, f, n in repeats(block, length)]
            block, held = [], 0

        for batch in batches:
            for h, doc_id, first, n, context in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    close_hash()
                    now, size, over = h, 0, False
                    if held >= BLOCK:
                        close_block()
                if over:
                    out.append((h, doc_id, first, n, context))
                elif context in seen:
                    out.append((None, doc_id, first, n, None))
                else:
                    seen.add(context)
                    own.append((doc_id, first, n, context))
                    size += len(context)
                    if size > MOST:
                        over = True
                        out += [(h, *c) for c in own]
                        own, seen = [], set()
                if len(out) >= 20_000:
                    yield arrow(list(zip(*out)), CONTEXTS)
                    out = []
        close_hash()
        close_block()
        yield arrow(list(zip(*out)), CONTEXTS)

    return run


def digest_batch(length: int):
    """A row for each string of a context: its digest and where it begins."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, first, n, context in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "context"))):
            out += [(hashlib.blake2b(context[i : i + length], digest_size=16).digest(), doc_id, first + i) for i in range(n)]
        return arrow(list(zip(*out)), "digest binary, doc_id long, first long")

    return run


def cut_batch(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, spans, kept = [], [], [], []
        open_up = zstandard.ZstdDecompressor().decompress
        for packed, marks in zip(batch.column("data").to_pylist(), batch.column("marks").to_pylist()):
            data, parts, end, runs = open_up(packed), [], 0, 0
            reach = -1  # where the present run ends; -1 before the first
            for first, n in sorted((m["first"], m["n"]) for m in marks or []):
                if first > reach:
                    parts.append(data[end:first])
                    runs += 1
                reach = max(reach, first + n + length - 1)
                end = reach
            parts.append(data[end:])
            whole = b"".join(parts)
            sizes.append(len(data))
            removed.append(len(data) - len(whole))
            spans.append(runs)
            kept.append(whole)
        carried = [c for c in batch.schema.names if c not in ("data", "marks")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())], [*carried, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = 100, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary for every row of docs (doc_id, text); with carry also `row`, a
    struct of the other columns.

    Null and empty texts and those of under `length` bytes lose nothing. Rows that share a doc_id stand at one place of
    the corpus: equal strings at equal starts in them are not earlier than each other, and what is marked in one is cut
    from all. A null doc_id comes before all others. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows if not carry else docs.select(*[F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(c) if c == "doc_id" else F.coalesce(c, F.lit("")).alias(c) for c in ("doc_id", "text")], F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))
    found = in_arrow(rows.where(F.octet_length("text") >= length), anchor_batch(length), ANCHORS)
    dealt = found.repartition("key").drop("key").sortWithinPartitions("h", "c", "d", "doc_id", "first")
    settled = materialise(dealt.mapInArrow(settle_partition, MARKS), "anchors")
    starts = settled.where("h is not null").groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "n")).alias("starts"))
    contexts = in_arrow(in_arrow(rows, pack_batch, "doc_id long, data binary").join(starts, "doc_id"), context_batch(length), CONTEXTS)
    met = contexts.repartition("h").sortWithinPartitions("h", "doc_id", "first")
    resolved = materialise(met.mapInArrow(resolve_partition(length), CONTEXTS), "resolved")
    strings = in_arrow(resolved.where("context is not null"), digest_batch(length), "digest binary, doc_id long, first long")
    earliest = strings.groupBy("digest").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    later = strings.join(earliest, "digest").where(F.struct("doc_id", "first") > F.col("least")).select("doc_id", "first", F.lit(1).alias("n"))
    known = settled.where("h is null").select("doc_id", "first", "n").unionByName(resolved.where("context is null").select("doc_id", "first", "n")).unionByName(later)
    of_doc = known.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    other = f"row {whole.schema['row'].dataType.simpleString()}, " if carry else ""
    packed = in_arrow(whole, pack_batch, f"doc_id long, {other}data binary")
    out = in_arrow(packed.join(of_doc, "doc_id", "left"), cut_batch(length), f"doc_id long, {other}n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
