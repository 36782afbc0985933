"""Running numbers and sums over keys of any size: rows are dealt by ranges of (key, order), and ranges add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions


def in_ranges(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df, stored, with `part`: its rows dealt into ranges of (key, order), numbered in that order.

    The numbers are those of the tasks that wrote the rows, so a task that runs again can't change them for those that read.
    A range holds about its share of all rows, but rows that are equal in key and order stay together.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    return materialise(df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).withColumn("part", F.spark_partition_id()), name)


def before(rows: DataFrame, key: str, value: Column, fold=F.sum, zero: int = 0) -> DataFrame:
    """key, part, base: the fold of `value` over the ranges of each key that come before. A key has a row for each of its
    ranges; `key` isn't null."""
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(key, "part").agg(fold(value).alias("own")).select(key, "part", F.coalesce(fold("own").over(earlier), F.lit(zero)).alias("base"))


def running(rows: DataFrame, key: str, order: list[str], value: Column, name: str, fold=F.sum, zero: int = 0) -> DataFrame:
    """Rows of in_ranges() with column `name`: the fold of `value` over the key's rows up to and with this one."""
    upto = Window.partitionBy(key, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    join = {"bit_xor": lambda a, b: a.bitwiseXOR(b), "sum": lambda a, b: a + b}[fold.__name__]
    return rows.withColumn(name, fold(value).over(upto)).join(before(rows, key, value, fold, zero), [key, "part"]).withColumn(name, join(F.col(name), F.col("base"))).drop("base")
