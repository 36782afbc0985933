"""Packing documents into training sequences: shortest-pack-first over the histogram of lengths.

A document's tokens are cut into full sequences and one rest. The histogram of the pieces' lengths (at most `length`
rows) is all that the driver sees: it places lengths from the longest to the shortest, each into the packs with the most
room, and keeps packs that look alike as one pattern with a count. What it made goes back as a table of placements
(length, ranks from-to -> sequences, offset), and every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_signs
from .common import docs_of, in_arrow, materialise, shuffle_partitions, slices

#: The split pattern of the byte-level vocabulary, and what its \s stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of this length or more is cut out by hand: the encoder's regular expression keeps a way back for each sign.
LONG_SPACE = re.compile(f"[{SPACE}]{{4096,}}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """The ids of a text in the byte-level vocabulary of a tokenizers file, with its added tokens found in texts as that
    library does. A text can have white space of any length."""
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    signs = byte_signs()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    added = tuple(special)

    def encode(text: str) -> np.ndarray:
        out, done = [], 0
        for run in LONG_SPACE.finditer(text):
            start, end = run.span()
            if end < len(text) and not text.startswith(added, end):
                end -= 1  # the last one is left to the word that follows
            out += [coder.encode_to_numpy(text[done:start], allowed_special="all"), np.array(coder._encode_single_piece(text[start:end]), "<u4")]
            done = end
        out.append(coder.encode_to_numpy(text[done:], allowed_special="all"))
        return np.concatenate(out).astype("<u4", copy=False)

    return encode


def cut(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, then the rest."""
    return [(i, min(length, tokens - i)) for i in range(0, tokens, length)]


def cut_batch(path: str, length: int, end_id: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = byte_encoder(path), []
        for part in slices(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(encode(text), np.array([end_id], "<u4"))
                out += [(doc_id, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)) for a, n in cut(len(ids), length)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def place(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, pieces a pack, first sequence, offset) for a histogram of piece lengths.

    The heap holds patterns: (-room, first sequence, number of sequences). The pattern with the most room takes as
    many pieces a pack as leave it the one with the most room, at least one.
    """
    out: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []
    made = 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]

        def put(n: int, each: int, first: int, room: int) -> None:
            nonlocal rank, left
            out.append((size, rank, each, first, length - room))
            rank += n * each
            left -= n * each
            if room > each * size:
                heapq.heappush(packs, (each * size - room, first, n))

        while left:
            if packs and -packs[0][0] >= size:
                room, first, n = heapq.heappop(packs)
                room = -room
                if left < n:
                    heapq.heappush(packs, (-room, first + left, n - left))
                    put(left, 1, first, room)
                else:
                    other = -packs[0][0] if packs else 0
                    put(n, max(1, min(room // size, -(-(room - other) // size), left // n)), first, room)
            else:
                each = min(length // size, left)
                n = left // each
                first, made = made, made + n
                put(n, each, first, length)
    return out


def ranked(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with their rank (from 0) among pieces of their length, and the histogram (length, count).

    Ranks are made from numbers within (length, bucket) and the buckets' running sums, so a length that most pieces
    share is dealt over all tasks.
    """
    buckets = max(16, shuffle_partitions(pieces.sparkSession))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    counts = rows.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "bucket", before.alias("base"))
    out = rows.withColumn("number", number).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("number") - 1)
    return out.drop("bucket", "base", "number"), counts.groupBy("length").agg(F.sum("count").alias("count"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each document.

    Null and empty texts are one piece, the end id alone; repeated rows are packed as often as they occur; an empty
    table gives an empty result; other columns are ignored; a text is encoded whole by one task, white space of any length
    included. The placements sent to the tasks have a size bound by
    `length` (their number doesn't grow with the documents).
    """
    pieces = materialise(in_arrow(docs_of(docs), cut_batch(tokenizer_path, length, end_id), PIECES), "pieces")
    rows, histogram = ranked(pieces)
    placed = place({r["length"]: r["count"] for r in histogram.collect()}, length)
    table = np.array(placed or [(0, 0, 1, 0, 0)], np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    base = np.int64(1) << 48
    keys = table[:, 0] * base + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = table[np.searchsorted(keys, size * base + rank, side="right") - 1]
        i = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + i // at[:, 2], "offset": at[:, 4] + i % at[:, 2] * size})

    return rows.withColumn("place", find("length", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
