"""Bootstrap by hashed Poisson weights: one pass, no resampled copies of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import split, stats

#: Cumulative chances of a Poisson variable of mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def poisson(x: Column) -> Column:
    """A Poisson(1) number from a uniform one."""
    return sum((x > p).cast("int") for p in POISSON)


def weighted_users(users: DataFrame, rounds: int) -> DataFrame:
    """users for each round, with a Poisson weight w from the user and the round."""
    drawn = users.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return drawn.withColumn("w", poisson(split.uniform("boot:", "u", "round")))


def interval(each: DataFrame, value: str) -> list[Column]:
    """Mean and the bounds between which 95 % of the rounds lie: as many values as there are rounds."""
    return [F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high")]


def user_bootstrap(rows: DataFrame, rounds: int) -> DataFrame:
    """One row: mean, low and high (2.5 % and 97.5 %) of the row accuracy; users are summed up before they are weighted."""
    users = rows.groupBy("u").agg(F.sum((F.col("pred") == F.col("label")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n"))
    each = weighted_users(users, rounds).groupBy("round").agg((F.sum(F.col("w") * F.col("right")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("acc"))
    return each.agg(*interval(each, "acc"))


def paired_bootstrap(rows: DataFrame, first: str, second: str, rounds: int) -> DataFrame:
    """One row: mean, error (sample deviation), low and high of the gain in row accuracy from the first labels to the
    second, by the same resampled users."""
    right = lambda c: F.sum((F.col(c) == F.col("label")).cast("int"))
    users = rows.groupBy("u").agg((right(second) - right(first)).alias("gain"), F.count(F.lit(1)).alias("n"))
    each = weighted_users(users, rounds).groupBy("round").agg((F.sum(F.col("w") * F.col("gain")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("delta"))
    return each.agg(*interval(each, "delta"), F.stddev_samp("delta").alias("error")).select("mean", "error", "low", "high")


def auc_bootstrap(rows: DataFrame, rounds: int) -> DataFrame:
    """One row: mean, low and high of the AUC of (id, score, label) over resampled rows."""
    drawn = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", poisson(split.uniform("auc:", "id", "round")))
    hist = drawn.groupBy("round", "score").agg(F.sum(F.col("w") * F.col("label")).alias("p"), F.sum(F.col("w") * (1 - F.col("label"))).alias("m"))
    each = stats.auc_of_counts(hist, "score", ("round",))
    return each.agg(*interval(each, "auc"))
