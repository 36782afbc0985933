"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a shared folder. A call joins the digests
of the normalised contents with the stored counts, encodes one document for each content that has none, appends the new
counts and joins them back. Normalisation maps null to the empty text and changes nothing else: any other rule (case,
white space, Unicode forms) would change the counts of the tokenizers in use.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, in_arrow, materialise, scratch, slices, stored_table

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts, for a .model (sentencepiece) or a .json (tokenizers) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: library, its version and the file's bytes."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def count_batch(path: str, name: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, out = counter(path), []
        for part in slices(batch):
            out += count(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([name] * len(out), pa.string()), pa.array(out, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str | None, name: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row per content; an absent table is an empty one."""
    return stored_table(spark, path, CACHE_SCHEMA).where(F.col("tokenizer_digest") == name).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    Null and empty texts have 0 bytes and the tokenizer's count of the empty text; repeated rows and copies each get a
    row, their content is encoded once; an empty table gives an empty result; other columns are ignored. Two jobs that
    append to one cache at a time may store a content twice, with equal counts, which reading folds.
    """
    spark = docs.sparkSession
    name = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or scratch(spark, "token-cache", keep=False)
    rows = docs_of(docs).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    stored = materialise(read_cache(spark, cache_path, name), "token-cache-hits")
    # One document stands for each content that the cache lacks; rows that share id and content fold into one before they
    # move, so a group of any size is a row for each task that reads it, and is encoded once.
    missing = keys.groupBy("content_digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id")).join(stored, "content_digest", "left_anti")
    each = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).groupBy("content_digest", "doc_id").agg(F.first("text").alias("text"))
    texts = each.join(missing, ["content_digest", "doc_id"], "left_semi")
    counted = in_arrow(texts.select("content_digest", "text"), count_batch(tokenizer_path, name), CACHE_SCHEMA)
    counted.write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, name)
    return keys.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
