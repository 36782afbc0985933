"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.session import materialise, scratch, shared_dir, ship, shuffle_partitions

__all__ = ["beside", "docs_of", "held", "with_new", "in_arrow", "labelled_sample", "materialise", "scratch", "shared_dir", "ship", "shuffle_partitions", "slices", "stored_table", "table", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_table(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The Parquet table at path; one that isn't there is an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty: other columns cannot clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """The one large object (a model, an encoder) that a worker keeps between batches and tasks: another name takes its
    place."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def give_back(keep: str | None = None) -> None:
    """Free what a worker holds but for the object of this name, and hand free memory back to the system: workers serve one
    operator after another, and an executor's share must not fill up with what earlier ones left."""
    import ctypes

    for name in [n for n in _HELD if n != keep]:
        del _HELD[name]
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def beside(columns: list[str], made: tuple[str, ...], keep_text: bool = False) -> list[str]:
    """The columns that stay beside an operator's new ones: all but those of the new names, and text if it isn't kept."""
    return [c for c in columns if c.lower() not in made and (keep_text or c.lower() != "text")]


def with_new(df: DataFrame, made: str, keep_text: bool = False) -> tuple[DataFrame, StructType]:
    """df without the columns that give way to the new ones, and the schema of what stays with the new ones behind it."""
    new = StructType.fromDDL(made)
    stay = beside(df.columns, tuple(new.names), keep_text)
    kept = df.select(*[F.col(f"`{c}`") for c in (stay if keep_text else [*stay, "text"])])
    return kept, StructType([*[kept.schema[c] for c in stay], *new.fields])


def in_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, keep: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; keep: the name of the object that it has from held()."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep)
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out
        give_back(keep)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded text volume (a single longer text stands alone)."""
    import numpy as np

    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(np.asarray(sizes).tolist()):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def unit_hash(*cols, seed: str = ""):
    """A uniform number in [0, 1) that depends only on the given values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, seed: str) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, label (0/1) of about `sample` documents of each label, and the share of each label that was taken.

    The choice is made on (doc_id, label) alone, by a hash of the id; what is then joined to the texts has a size bound
    by `sample`, so the texts aren't shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    rate = {y: min(1.0, sample / max(1, sizes.get(y, 0))) for y in (0, 1)}
    chosen = known.where(unit_hash("doc_id", seed=seed) < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), rate
