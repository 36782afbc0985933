"""Reading logs, candidates and score files; writing submissions."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import ship

LOG = "userID string, gameID string, text string, date string, hours double, hours_transformed double, early_access boolean, found_funny double, compensation string, user_id string"


def literal_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold a Python dict literal, as columns; absent keys are null. Blank lines are skipped; a line that
    isn't a dict literal comes with its text in _corrupt. Adds flags for the optional keys and the text's length."""
    ship(spark)
    names = [f.split()[0] for f in LOG.split(", ")]

    @F.pandas_udf(f"{LOG}, _corrupt string")
    def parsed(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            try:
                row = ast.literal_eval(line)
                if not isinstance(row, dict):
                    raise ValueError("not a dict")
                row = {k: row.get(k) for k in names} | {"_corrupt": None}
                for k in ("hours", "hours_transformed", "found_funny"):
                    row[k] = None if row[k] is None else float(row[k])
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                row = dict.fromkeys(names) | {"_corrupt": line}
            out.append(row)
        return pd.DataFrame(out, columns=[*names, "_corrupt"])

    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed("value").alias("r")).select("r.*")
    rows = rows.withColumns({"hours": F.coalesce("hours", F.lit(0.0)), "date": F.col("date").try_cast("timestamp")})
    return rows.withColumns({"text_len": F.coalesce(F.char_length("text"), F.lit(0)), "has_found_funny": F.col("found_funny").isNotNull(), "has_compensation": F.col("compensation").isNotNull()})


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension: .csv with a header, .json literal lines, else Parquet.

    A CSV with a schema is read once; without one Spark reads it twice to infer it. A column `date` becomes a timestamp,
    null where it isn't one.
    """
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        return rows.withColumn("date", F.col("date").cast("string").try_cast("timestamp")) if "date" in rows.columns else rows
    return literal_logs(spark, path) if path.endswith(".json") else spark.read.parquet(path)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds row_idx, from 0 in the order of a column of distinct values, without bringing the rows into one task."""
    from rankloom.operators import stats

    return stats.prefix_sums(df.withColumn("row_idx", F.lit(1)), order, ["row_idx"]).drop("row_idx").withColumnRenamed("row_idx_before", "row_idx")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return require(read_table(spark, path), "ID", "userID", "gameID").withColumn("ID", F.col("ID").cast("int"))


def scores(df: DataFrame, keys: tuple[str, ...] = ("ID", "userID", "gameID"), prefix: str = "") -> DataFrame:
    """Keys and score_* columns, these with a prefix."""
    return require(df, *keys).select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c.startswith("score_")])


def score_columns(df: DataFrame, include: str | None = None, exclude: str | None = None, wanted: list[str] | None = None) -> list[str]:
    """The score_* columns, or the wanted ones, that the pattern `include` is found in and `exclude` isn't."""
    names = require(df, *wanted).select(*wanted).columns if wanted else [c for c in df.columns if c.startswith("score_")]
    return [c for c in names if (include is None or re.search(include, c)) and (exclude is None or not re.search(exclude, c))]


def ensemble(files: list[DataFrame], score: str, keys: tuple[str, ...] = ("ID",), strict: bool = True) -> DataFrame:
    """Keys with mean, sd (population) and n of a score over several files.

    strict: a key that doesn't stand once in every file is an error when the result is computed; else n tells.
    """
    rows = files[0].select(*keys, score)
    for f in files[1:]:
        rows = rows.unionByName(f.select(*keys, score))
    out = rows.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("n"))
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit("not once in every file: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return out.withColumn("n", F.when(F.col("n") == len(files), F.col("n")).otherwise(missing.cast("long")))


def label_file(df: DataFrame) -> DataFrame:
    """ID, label of a file whose label column is called Label or Played."""
    name = next((c for c in ("Label", "Played") if c in df.columns), None)
    if name is None:
        raise ValueError("missing columns: Label or Played")
    return require(df, "ID").select(F.col("ID").cast("long").alias("ID"), F.col(name).try_cast("int").alias("label"))


def label_checks(df: DataFrame) -> DataFrame:
    """One row: n_rows, ids, lo, hi, not_binary (labels other than 0 and 1, or none), contiguous (1 if the IDs are all
    the numbers from lo to hi, once each)."""
    out = label_file(df).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ID").alias("ids"), F.min("ID").alias("lo"), F.max("ID").alias("hi"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("not_binary"))
    whole = (F.col("ids") == F.col("n_rows")) & (F.col("hi") - F.col("lo") + 1 == F.col("n_rows"))
    return out.withColumn("contiguous", F.coalesce(whole, F.lit(False)).cast("int"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Each row as a JSON object in a line of its own, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(df: DataFrame) -> DataFrame:
    """line: a row as a line of a Markdown table, nulls as empty cells, bars escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\\R", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def write_markdown(df: DataFrame, path: str) -> None:
    """A table of a report as Markdown, in one file and in the order of df: meant for summaries, not for data."""
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "line string").coalesce(1)
    head.unionByName(markdown(df).coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def write_submission(df: DataFrame, path: str) -> None:
    """ID, Label as CSV in the order of ID, in as many files as Spark has partitions."""
    require(df, "ID", "Label").select("ID", "Label").orderBy("ID").write.mode("overwrite").option("header", True).csv(path)
