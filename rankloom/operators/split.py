"""Hold-out splits and negative sampling, deterministic by hashes of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import stats
from rankloom.session import materialise


def hash_key(seed: str, *cols: str) -> Column:
    """md5 of seed and keys joined by ':' as hexadecimal text: an order that every engine shares."""
    return F.md5(F.concat(F.lit(seed), F.concat_ws(":", *[F.col(c).cast("string") for c in cols])))


def hash_long(seed: str, *cols: str) -> Column:
    """The first 15 hexadecimal digits of hash_key as a number below 2^60."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 15), 16, 10).cast("long")


def uniform(seed: str, *cols: str) -> Column:
    """hash_long as a number in (0, 1)."""
    return (hash_long(seed, *cols) + 1) / F.lit(float(2**60 + 1))


def hold_out_sizes(inter: DataFrame, least: int = 10, share: int = 10, most: int = 5) -> DataFrame:
    """u, k: min(history div share, most) held-out items for users with at least `least` items."""
    return inter.groupBy("u").agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") >= least).select("u", F.least(F.floor(F.col("n_items") / share).cast("long"), F.lit(most).cast("long")).alias("k"))


def hold_out(inter: DataFrame, seed: str = "42:", order: str = "hash", sizes: DataFrame | None = None) -> DataFrame:
    """u, i: the k held-out items of each user, by hash or the most recent ones."""
    keys = [hash_key(seed, "u", "i"), F.col("i")] if order == "hash" else [F.col("d").desc(), F.col("i")]
    ranked = inter.join(hold_out_sizes(inter) if sizes is None else sizes, "u").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*keys)))
    return ranked.where("r <= k").select("u", "i")


def in_places(items: DataFrame) -> DataFrame:
    """i, place: the items numbered without gaps from 0 on, whatever their own numbers are."""
    from rankloom.operators.factors import items_in_order

    return materialise(items_in_order(items), "item-places")


def at_places(draws: DataFrame, items: DataFrame, number: Column) -> DataFrame:
    """draws with i: the item at the place `number` modulo the number of items (i, place)."""
    size = items.agg(F.count(F.lit(1)).alias("size")).where("size > 0")
    return draws.crossJoin(F.broadcast(size)).withColumn("place", number % F.col("size")).join(items, "place").drop("place", "size")


def proposed_negatives(sizes: DataFrame, items: DataFrame, seen: DataFrame, seed: str, tries: int = 6) -> DataFrame:
    """u, i: k unseen items for each user, uniform without replacement.

    Instead of all unseen items, each user draws tries * k places among the items (place, i) by hash; those that are
    unseen are taken in the order of the draws. Its size follows the users, not users times items.
    """
    drawn = at_places(sizes.select("u", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") * tries - 1)).alias("j")), items, hash_long(seed, "u", "j"))
    fresh = drawn.groupBy("u", "k", "i").agg(F.min("j").alias("j")).join(seen.select("u", "i"), ["u", "i"], "left_anti")
    return fresh.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("j"))).where("r <= k").select("u", "i")


#: Draws for each wanted item, round by round.
ROUNDS = (3, 48, 384)


def until_full(sizes: DataFrame, items: DataFrame, seen: DataFrame, propose, order: list[Column], keys: tuple[str, ...] = ("u",), rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """keys, i: what propose(sizes, draws) gives, in further rounds for those with fewer than k, until all have k or all
    unseen items.

    propose makes so many draws for each wanted item; those of a round begin with the ones of the round before. So what a
    short first round finds is what a long one would take. For those short after the last round, unseen items are rare
    among the draws: theirs are listed and fill up in the given order.
    """
    keys = list(keys)
    done, short = None, sizes.select(*keys, "k")
    for draws in rounds:
        rows = materialise(propose(short, draws).select(*keys, "i"), "negatives")
        counted = short.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("had")), keys, "left").select(*keys, "k", F.coalesce("had", F.lit(0)).alias("had"))
        left = materialise(counted.where("had < k"), "short")
        full = rows.join(left, keys, "left_anti")
        done = full if done is None else done.unionByName(full)
        if left.isEmpty():
            return done
        short = left.select(*keys, "k")
    shared = [k for k in keys if k in items.columns]
    pool = left.join(items, shared) if shared else left.crossJoin(items)
    rest = pool.join(seen.select("u", "i"), ["u", "i"], "left_anti").join(rows, [*keys, "i"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r <= k - had")
    return done.unionByName(rows.join(left, keys, "left_semi")).unionByName(rest.select(*keys, "i"))


def whole_negatives(sizes: DataFrame, items: DataFrame, seen: DataFrame, seed: str) -> DataFrame:
    """u, i: as proposed_negatives, but every user gets k unseen items, or all of them if there are fewer."""
    placed = in_places(items)
    propose = lambda short, draws: proposed_negatives(short, placed, seen, seed, draws)
    return until_full(sizes, items.select("i").distinct(), seen, propose, [hash_key(seed, "u", "i"), F.col("i")])


def weighted_negatives(sizes: DataFrame, items: DataFrame, seen: DataFrame, seed: str, keys: tuple[str, ...] = ("u",)) -> DataFrame:
    """keys, i: k unseen items for each user, drawn from all items (i, w) one after the other without replacement, each
    with a chance in proportion to its whole-numbered weight w.

    keys beside u, such as a bin, are columns of items too; draws then stay within them. A draw is a number below the sum
    of the weights, which meets the item in whose stretch of the running sum it lies. Items and draws meet by the number
    of an equal part of the sum, so the join is one of equal keys, even where few items have most of the weight. Items
    without weight are only taken when there are no others.
    """
    inner = tuple(k for k in keys if k != "u")
    heavy = stats.prefix_sums(items.where("w > 0").select(*inner, "i", F.col("w").cast("long").alias("w")), "i", ["w"], inner)
    heavy = materialise(heavy.withColumnRenamed("w_before", "lo").withColumn("hi", F.col("lo") + F.col("w")), "stretches")
    total = heavy.groupBy(*inner).agg(F.max("hi").alias("all"), F.ceil(F.max("hi") / F.count(F.lit(1))).cast("long").alias("width"))
    widths = lambda rows: rows.join(total, list(inner)) if inner else rows.crossJoin(F.broadcast(total))
    spans = widths(heavy).select(*inner, "i", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))).alias("part"))

    def propose(short: DataFrame, draws: int) -> DataFrame:
        drawn = widths(short.select(*keys, "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") * draws - 1)).alias("j")))
        drawn = drawn.withColumn("x", hash_long(seed, *keys, "j") % F.col("all")).withColumn("part", F.floor(F.col("x") / F.col("width")))
        met = drawn.join(spans, [*inner, "part"]).where("x >= lo and x < hi").groupBy(*keys, "k", "i").agg(F.min("j").alias("j"))
        fresh = met.join(seen.select("u", "i"), ["u", "i"], "left_anti")
        return fresh.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("j"))).where("r <= k")

    order = [F.desc("w"), hash_key(seed, *keys, "i"), F.col("i")]
    return until_full(sizes, items, seen, propose, order, keys)


def binned_negatives(wanted: DataFrame, items: DataFrame, seen: DataFrame, seed: str) -> DataFrame:
    """u, i, in_bin: for each user and popularity bin as many unseen items (i, bin, w) as wanted (u, bin, k), drawn by
    weight; what a bin can't give comes from all other unseen items, also by weight."""
    inside = materialise(weighted_negatives(wanted, items, seen, seed, keys=("u", "bin")).select("u", "i"), "in-bin")
    total = wanted.groupBy("u").agg(F.sum("k").alias("total"))
    had = inside.groupBy("u").agg(F.count(F.lit(1)).alias("had"))
    short = total.join(had, "u", "left").select("u", (F.col("total") - F.coalesce("had", F.lit(0))).alias("k")).where("k > 0")
    rest = weighted_negatives(short, items.drop("bin"), seen.select("u", "i").unionByName(inside), f"{seed}rest:")
    return inside.withColumn("in_bin", F.lit(1)).unionByName(rest.select("u", "i", F.lit(0).alias("in_bin")))


def community_negatives(wanted: DataFrame, items: DataFrame, seen: DataFrame, seed: str) -> DataFrame:
    """u, i: for each user, community and bin as many unseen items (community, bin, i, w) as wanted (u, community, bin, k),
    drawn by weight.

    Bins may share items. What two bins of a user draw is taken once, and made up for from all bins of the community.
    """
    first = materialise(weighted_negatives(wanted, items, seen, seed, keys=("u", "community", "bin")).select("u", "i").distinct(), "by-bin")
    total = wanted.groupBy("u", "community").agg(F.sum("k").alias("total"))
    had = first.groupBy("u").agg(F.count(F.lit(1)).alias("had"))
    short = total.join(had, "u", "left").select("u", "community", (F.col("total") - F.coalesce("had", F.lit(0))).alias("k")).where("k > 0")
    whole = items.groupBy("community", "i").agg(F.max("w").alias("w"))
    rest = weighted_negatives(short, whole, seen.select("u", "i").unionByName(first), f"{seed}rest:", keys=("u", "community"))
    return first.unionByName(rest.select("u", "i"))


def triplets(pairs: DataFrame, items: DataFrame, seen: DataFrame, seed: str) -> DataFrame:
    """u, pos, neg: for each pair (u, i) an item that the user hasn't seen, by the first hash draw that hits one; for
    users who have seen nearly all, one of what is left. Users who have seen all have no row."""
    placed = in_places(items)

    def propose(short: DataFrame, draws: int) -> DataFrame:
        drawn = at_places(short.select("u", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j")), placed, hash_long(seed, "u", "pos", "j"))
        fresh = drawn.join(seen.select("u", "i"), ["u", "i"], "left_anti")
        return fresh.groupBy("u", "pos").agg(F.min_by("i", "j").alias("i"))

    sizes = pairs.select("u", F.col("i").alias("pos"), F.lit(1).cast("long").alias("k"))
    return until_full(sizes, items.select("i").distinct(), seen, propose, [hash_key(seed, "u", "pos", "i")], ("u", "pos"), (1, *ROUNDS[1:])).withColumnRenamed("i", "neg")


def candidates(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """id, u, i, label: both kinds together; id = 16 u + position by item."""
    rows = positives.select("u", "i", F.lit(1).alias("label")).unionByName(negatives.select("u", "i", F.lit(0).alias("label")))
    return rows.select((F.col("u") * 16 + F.row_number().over(Window.partitionBy("u").orderBy("i", "label"))).alias("id"), "u", "i", "label")


def folds(users: DataFrame, n: int, seed: str = "fold:") -> DataFrame:
    """u, fold in 0..n-1 by hash."""
    return users.select("u", (hash_long(seed, "u") % n).cast("int").alias("fold"))


def stratified_folds(users: DataFrame, stratum: str, n: int, seed: str = "strata:") -> DataFrame:
    """u, stratum, fold in 0..n-1: the users of a stratum in hash order, dealt out one after the other, so that folds of a
    stratum differ by one user at most."""
    rows = users.select("u", stratum).withColumns({"one": F.lit(1), "place": F.struct(hash_key(seed, "u").alias("h"), F.col("u"))})
    return stats.prefix_sums(rows, "place", ["one"], (stratum,)).select("u", stratum, (F.col("one_before") % n).cast("int").alias("fold"))


def edge_dropout(edges: DataFrame, rate: float, seed: str) -> DataFrame:
    """The edges (u, i) whose hash number is at least `rate`."""
    return edges.where(uniform(seed, "u", "i") >= rate)


def checks(train: DataFrame, cand: DataFrame) -> DataFrame:
    """One row of counts that must be 0, and sizes: overlap with training, unbalanced users, unknown users and items."""
    overlap = cand.join(train.select("u", "i"), ["u", "i"], "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
    uneven = cand.groupBy("u").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("p") * 2 != F.col("n")).alias("uneven_users"), F.count(F.lit(1)).alias("users"))
    cold = cand.select("u").distinct().join(train.select("u").distinct(), "u", "left_anti").agg(F.count(F.lit(1)).alias("cold_users"))
    size = cand.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"), F.count_distinct("id").alias("ids"))
    return size.crossJoin(overlap).crossJoin(uneven).crossJoin(cold)
