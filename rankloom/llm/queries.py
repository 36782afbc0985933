"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, merkle, minhash, packing, prefix_trie, quality, secret_scan, suffix_dedup, token_counts, topk, toxicity, winnowing
from .common import table
from .oracles import oracle_sql  # noqa: F401  part of what the entry reads


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(language_id.bucket("doc_id", 4) == 2, F.lit(False)))
    model = language_id.fit(docs.where("not held_out").select("doc_id", "text", "lang"), vocabulary)
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, vocabulary)


def folded(spark: SparkSession, sf_dir: str, label: str, fold: Column) -> tuple[DataFrame, DataFrame]:
    """All documents with held_out, and the labels that may be learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold, F.lit(False)))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs, labels.where(~F.coalesce(fold, F.lit(True)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = folded(spark, sf_dir, "toxic", language_id.bucket("doc_id", 5) == 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = folded(spark, sf_dir, "quality", language_id.bucket("doc_id", 3) == 1)
    return quality.score(docs, quality.fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("findings", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("findings")).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_minhash": op2_minhash, "op3_suffix_dedup": op3_suffix_dedup, "op4_language_id": op4_language_id, "op7_toxicity": op7_toxicity, "op8_quality": op8_quality, "op5_token_counts": op5_token_counts, "op6_winnowing": op6_winnowing, "op9_topk": op9_topk, "op10_bpe": op10_bpe, "op11_secret_scan": op11_secret_scan, "op12_merkle_manifest": op12_merkle_manifest, "op13_prefix_trie": op13_prefix_trie}
