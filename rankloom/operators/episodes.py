"""Training episodes: sets of exactly k positives among 2k items, their likelihood, and negatives shared by a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import split


def symmetric_polynomial(values: str | Column, k: Column) -> Column:
    """The elementary symmetric polynomial of degree k of an array of doubles: the sum over all sets of k of the products
    of their values, by a fold that keeps the polynomials of degrees 0 to k of the values so far."""
    degrees = F.sequence(F.lit(0), k.cast("int"))
    start = F.transform(degrees, lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    return F.element_at(F.aggregate(values, start, lambda e, x: F.zip_with(e, F.concat(F.array(F.lit(0.0)), F.slice(e, 1, k.cast("int"))), lambda now, lower: now + x * lower)), -1)


def exact_k_likelihood(rows: DataFrame, score: str, key: str = "u") -> DataFrame:
    """key, k, n, loglik: of each group of rows (key, label, score), the logarithm of the chance that its k positives are
    what a choice of k of its n rows gives, if the chance of a choice goes with the product of exp(score).

    Groups are a user's candidates or an episode, so their arrays are small. The largest score is taken out first.
    """
    top = F.max(score).over(Window.partitionBy(key))
    rows = rows.select(key, F.col("label").cast("int").alias("label"), (F.col(score) - top).alias("s"))
    groups = rows.groupBy(key).agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == 1, F.col("s")).otherwise(0.0)).alias("own"), F.array_sort(F.collect_list(F.exp("s"))).alias("e"))
    return groups.select(key, "k", "n", (F.col("own") - F.log(symmetric_polynomial("e", F.col("k")))).alias("loglik"))


def episodes(train: DataFrame, items: DataFrame, seen: DataFrame, k: int, seed: str) -> DataFrame:
    """u, i, label: for each user with k training items or more, k of them by hash and k unseen items.

    Users who have seen all but fewer than k items have no episode, so every episode has exactly k of each.
    """
    ranked = train.select("u", "i").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(split.hash_key(f"{seed}p:", "u", "i"), "i")))
    positives = ranked.where(F.col("r") <= k).select("u", "i", F.lit(1).alias("label"))
    enough = positives.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("u", F.lit(k).cast("long").alias("k"))
    negatives = split.whole_negatives(enough, items, seen, f"{seed}n:").withColumn("label", F.lit(0))
    full = negatives.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("u")
    return positives.unionByName(negatives).join(full, "u", "left_semi")


def shared_negatives(pairs: DataFrame, items: DataFrame, seen: DataFrame, batches: int, draws: int, seed: str) -> DataFrame:
    """u, i, batch, neg: pairs (u, i) dealt into batches by hash; each batch draws `draws` items for all its pairs, and a
    pair takes those that its user hasn't seen. The draws follow the batches, not the pairs; a batch's size is what
    `batches` makes it."""
    dealt = pairs.select("u", "i", (split.hash_long(f"{seed}b:", "u", "i") % batches).alias("batch"))
    drawn = dealt.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j"))
    drawn = split.at_places(drawn, split.in_places(items), split.hash_long(f"{seed}d:", "batch", "j")).select("batch", F.col("i").alias("neg")).distinct()
    met = dealt.join(drawn, "batch")
    return met.join(seen.select("u", F.col("i").alias("neg")), ["u", "neg"], "left_anti").select("u", "i", "batch", "neg")
