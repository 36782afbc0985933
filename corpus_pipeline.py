"""Corpus pipeline: from raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import language_id, minhash, packing, suffix_dedup, toxicity
from rankloom.llm.common import materialise, table

#: SQL can't express the stages.
ORACLE_SQL = None
#: A document goes if it is toxic with at least this chance, or its language is known with less than that one.
TOXIC, CERTAIN = 0.5, 0.5


def beside_text(docs: DataFrame) -> DataFrame:
    """Each row as its text and a struct of all else, so that no column can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def again(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What beside_text() took apart, with the columns in their order."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are toxic; learned from labels of all folds but the held-out one.

    Null and empty texts have the score of no neighbours and stay; so do all documents if no label can be learned from.
    Rows with a null id or with the same id are judged by their own texts.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(language_id.bucket("doc_id", 5) != 0)
    scored = toxicity.score(beside_text(docs), toxicity.fit(docs, labels), evidence=0, keep_text=True)
    return again(scored.where(F.col("score") < TOXIC), docs.columns)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter or whose language stays unknown.

    Null texts have no letter. If no language can be learned, all documents stay. Rows with a null id or with the same id
    are judged by their own texts.
    """
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    known = docs.select("doc_id", "text", "lang").where(language_id.bucket("doc_id", 4) != 2)
    model = language_id.fit(known, vocabulary)
    if not model[0]:
        return docs
    found = language_id.identify(beside_text(docs), model, vocabulary, keep_text=True)
    return again(found.where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Rows with a null id stay, as do null and empty texts, which are like nothing. Rows that share an id are one document:
    all of them stay or go.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier string of 100; a sign cut in two goes whole.

    A text that is all repeats stays as an empty one, a null text becomes empty, n_chars follows the text. Earlier means a
    smaller id, or an earlier place in the text; null ids come first, and rows that share an id lose the same bytes.
    """
    out = suffix_dedup.without_repeats(docs, carry=True)
    text = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))
    out = out.withColumn("new_text", text)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    return out.select(*[(columns[c] if c in columns else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed pieces of at most 2048 tokens; null and empty texts are their end token alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("language", language_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
