"""Exact top-k by inner product: tiles of queries times shards of candidates.

Candidates are dealt to shards by a hash of their id and queries to tiles, each packed into one row that holds a matrix.
A query tile is sent to every shard by an equi join on the shard number; each pair of tiles is one matrix product, from
which every query keeps its best k; those lists are merged as a tree. The products are of integers and exact: in double
precision where no sum can leave 2^53, else in 64-bit integers, and where these might not do in integers of any size; a
score that isn't a long is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, ship

TILE = "dim int, part int, ids binary, vectors binary"


def packed(df: DataFrame, parts: int) -> DataFrame:
    """One row for each (dim, part): ids and vectors as little-endian 64-bit integers. A part's size is bound by the number of parts."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(pdf["vector"].tolist(), "<i8").reshape(len(pdf), key[0])
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vectors": [rows.tobytes()]})

    ship(df.sparkSession)
    rows = df.withColumn("dim", F.size("vector")).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int"))
    return rows.groupBy("dim", "part").applyInPandas(one, TILE)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids, in that order."""
    n = len(scores)
    if n > k:
        edge = np.partition(scores, n - k)[n - k]
        where = np.flatnonzero(scores >= edge)
    else:
        where = np.arange(n)
    return where[np.lexsort((ids[where], -scores[where]))[:k]]


def tile_batch(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        queries, parts, lists = [], [], []
        for row in batch.to_pylist():
            q, c = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            a, b = (np.frombuffer(row[x], "<i8").reshape(len(ids), row["dim"]) for x, ids in (("q_vectors", q), ("vectors", c)))
            top = [max(-int(x.min()), int(x.max()), 0) if x.size else 0 for x in (a, b)]
            most = top[0] * top[1] * max(1, row["dim"])
            kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
            for start in range(0, len(q), 256):
                some = a[start : start + 256]
                scores = (some.astype(kind) @ b.T.astype(kind)).astype(np.int64)
                for query, line in zip(q[start : start + 256].tolist(), scores):
                    others = c != query
                    at = np.flatnonzero(others)[best(line[others], c[others], k)]
                    queries.append(query)
                    parts.append(row["part"])
                    lists.append([{"less": -s, "vec_id": v} for s, v in zip(line[at].tolist(), c[at].tolist())])
        if not queries:
            return None
        tops = pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(parts, pa.int32()), pa.array(lists, tops)], ["query_id", "part", "top"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 8192, tile_rows: int = 1024, fan_in: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each query row.

    vectors and queries: vec_id long, vector array<long> without nulls. Rows with a null id or vector take no part;
    vectors of different lengths aren't compared; a query repeated in id and vector counts once; candidates with the
    query's id are the query's own; ties go to the smaller id; empty tables give an empty result. A score beyond 64 bits
    is an OverflowError, never a wrapped number.
    """
    vectors = vectors.select("vec_id", "vector").where("vec_id is not null and vector is not null")
    queries = queries.select("vec_id", "vector").where("vec_id is not null and vector is not null").distinct()
    shards = max(1, -(-vectors.count() // shard_rows))
    tiles = max(1, -(-queries.count() // tile_rows))
    asked = packed(queries, tiles).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"))
    pairs = asked.join(packed(vectors, shards), ["dim", "part"])
    lists = in_arrow(pairs.repartition(min(100_000, shards * tiles)), tile_batch(k), "query_id long, part int, top array<struct<less: long, vec_id: long>>")
    while True:
        shards = -(-shards // fan_in)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.groupBy("query_id", F.floor(F.col("part") / fan_in).cast("int").alias("part")).agg(merged)
        if shards == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))


def quantised(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, vector: floor(scale * component); rows with a null vector or a null or non-finite component are left out."""
    x = F.col("embedding")
    whole = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))), F.lit(False))
    return embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))
