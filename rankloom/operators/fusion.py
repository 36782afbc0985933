"""Fusing several score columns, and re-ranking near the boundary of the upper half."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import ranking


def with_z(rows: DataFrame, scores: list[str], mode: str = "samp") -> DataFrame:
    """Adds z_<score> for each score, standardised by user."""
    return rows.withColumns({f"z_{s}": ranking.z(s, mode=mode) for s in scores})


def mean_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns)) / len(columns)


def median_of(columns: list[str]) -> Column:
    values, n = F.array_sort(F.array(*columns)), len(columns)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])


def reciprocal_rank(positions: list[str], k: int) -> Column:
    """Sum of 1 / (k + position)."""
    return reduce(lambda a, b: a + b, [1.0 / (k + F.col(p)) for p in positions])


def deviation_of(columns: list[str]) -> Column:
    """Population deviation over the columns of a row."""
    mean = mean_of(columns)
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - mean) * (F.col(c) - mean) for c in columns]) / len(columns))


def votes(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Adds votes: in how many scores' upper half of its user a row stands."""
    for s in scores:
        rows = ranking.top_half(rows, s, pred=f"pred_{s}").drop("rank_in_user", "k_in_user")
    return rows.withColumn("votes", reduce(lambda a, b: a + b, [F.col(f"pred_{s}") for s in scores]))


def boundary_votes(rows: DataFrame, base: str, scores: list[str]) -> DataFrame:
    """Adds voted: +10 above the boundary band, -10 below it, and the number of votes inside; the band's width is a
    tenth of the user's training items, between 3 and 20."""
    rows = ranking.top_half(votes(rows, scores), base)
    width = F.greatest(F.lit(3), F.least(F.lit(20), F.ceil(F.col("deg") * 0.1)))
    outside = F.when(F.col("rank_in_user") <= F.col("k_in_user") - width, 10.0).when(F.col("rank_in_user") > F.col("k_in_user") + width, -10.0)
    return rows.withColumn("voted", F.coalesce(outside, F.col("votes").cast("double")))


def band_rescored(rows: DataFrame, base: str, other: str, width: int) -> DataFrame:
    """Adds rescored: base's z, and inside the band the mean of both scores' z."""
    rows = ranking.top_half(with_z(rows, [base, other]), base)
    return rows.withColumn("rescored", F.when(ranking.in_band(width), (F.col(f"z_{base}") + F.col(f"z_{other}")) / 2).otherwise(F.col(f"z_{base}")))


def residual_grid(rows: DataFrame, base: str, feature: str, weights: list[float], bands: list[int]) -> DataFrame:
    """Rows for each variant (w, band) with the score z(base) + w * z(feature) inside the band: one shuffle by
    (variant, user) decodes them all. The grid is a literal."""
    rows = ranking.top_half(with_z(rows, [base, feature], "pop"), base, pred="base_pred").withColumnRenamed("rank_in_user", "base_rank")
    grid = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("band")) for w in weights for n in bands]))
    rows = rows.withColumn("v", grid).select("*", "v.w", "v.band").drop("v")
    gate = (F.col("base_rank") > F.col("k_in_user") - F.col("band")) & (F.col("base_rank") <= F.col("k_in_user") + F.col("band"))
    return rows.withColumn("fused", F.round(F.col(f"z_{base}") + F.when(gate, F.col("w") * F.col(f"z_{feature}")).otherwise(0.0), 9)).drop("k_in_user")


def band_swaps(rows: DataFrame, base: str, other: str, width: int) -> DataFrame:
    """u, up_id, down_id: in each user's band the rows that base leaves out and other puts above the boundary, against
    those of the reverse kind, matched in the order of their places."""
    rows = ranking.top_half(ranking.top_half(rows, other, pred="other_pred").drop("rank_in_user", "k_in_user"), base)
    rows = rows.where(ranking.in_band(width) & (F.col("pred") != F.col("other_pred")))
    up = rows.where("pred = 0").select("u", F.col("id").alias("up_id"), F.row_number().over(Window.partitionBy("u").orderBy("rank_in_user")).alias("m"))
    down = rows.where("pred = 1").select("u", F.col("id").alias("down_id"), F.row_number().over(Window.partitionBy("u").orderBy(F.desc("rank_in_user"))).alias("m"))
    return up.join(down, ["u", "m"]).drop("m")


def promoted(rows: DataFrame, anchor: str, second: str, third: str, band: int, tau: float, guard: float, most: int) -> DataFrame:
    """rule, u, id, pred: rows that a rule lifts into the upper half (1) and those that leave it for them (0).

    In each user's band every row below the boundary meets every one above it. A rule says by the gaps of their z scores
    when the lower one wins: two of three gaps over tau; the third's, and the anchor's not under -guard; the second's and
    the third's; these two and the anchor's not under -guard. The rows with most wins go up, at most `most`, and as many
    with most losses go down.
    """
    rows = ranking.top_half(with_z(rows, [anchor, second, third]), anchor)
    rows = rows.where(ranking.in_band(band)).select("u", "id", "pred", *[F.round(f"z_{s}", 9).alias(n) for n, s in (("z1", anchor), ("z2", second), ("z3", third))])
    low, top = (rows.where(f"pred = {p}").select("u", F.col("id").alias(n), *[F.col(z).alias(f"{n}_{z}") for z in ("z1", "z2", "z3")]) for p, n in ((0, "cid"), (1, "tid")))
    d1, d2, d3 = (F.col(f"cid_{z}") - F.col(f"tid_{z}") for z in ("z1", "z2", "z3"))
    fires = {"vote2": sum((d > tau).cast("int") for d in (d1, d2, d3)) >= 2, "vote_other": (d3 > tau) & (d1 > -guard), "vote_both": (d2 > tau) & (d3 > tau), "against_anchor": (d3 > tau) & (d2 > tau) & (d1 > -guard)}
    met = low.join(top, "u").select("u", "cid", "tid", F.explode(F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in fires.items()]), lambda x: x.isNotNull())).alias("rule"))
    wins = met.groupBy("rule", "u", F.col("cid").alias("id")).agg(F.count(F.lit(1)).alias("n_won")).join(rows.drop("u", "pred"), "id")
    by_rule = Window.partitionBy("rule", "u")
    up = wins.withColumn("m", F.row_number().over(by_rule.orderBy(F.desc("n_won"), F.round(F.col("z3") + F.col("z2"), 8).desc(), F.desc("z1"), "id")))
    tops = rows.where("pred = 1").groupBy("u").agg(F.count(F.lit(1)).alias("tops"))
    room = up.groupBy("rule", "u").agg(F.count(F.lit(1)).alias("n")).join(tops, "u").select("rule", "u", F.least("n", F.lit(most).cast("long"), "tops").alias("room"))
    losses = met.groupBy("rule", F.col("tid").alias("id")).agg(F.count(F.lit(1)).alias("n_lost"))
    down = room.join(rows.where("pred = 1").drop("pred"), "u").join(losses, ["rule", "id"], "left")
    down = down.withColumn("m", F.row_number().over(by_rule.orderBy(F.coalesce("n_lost", F.lit(0)).desc(), F.round(F.col("z3") + F.col("z2"), 8), "z1", F.desc("id"))))
    out = [up.join(room, ["rule", "u"]).where("m <= room").select("rule", "u", "id", F.lit(1).alias("pred")), down.where("m <= room").select("rule", "u", "id", F.lit(0).alias("pred"))]
    return out[0].unionByName(out[1])


def budgeted(swaps: DataFrame, gain: str, budget: int) -> DataFrame:
    """The best swap of each user, and of these the `budget` with the largest gain."""
    first = swaps.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.col(gain).desc(), "up_id", "down_id"))).where("r = 1").drop("r")
    return first.orderBy(F.col(gain).desc(), "u").limit(budget)


def negative_weights(rows: DataFrame, score: str, betas: list[float]) -> DataFrame:
    """beta, weighted share of right negatives: rows with label 0 weighted by exp(beta z), z over all negatives.

    Each beta meets the histogram of scores, not the rows.
    """
    neg = rows.where("label = 0")
    scale = neg.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"))
    hist = neg.groupBy(F.col(score).alias("value")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("pred") == 0).alias("ok"))
    z = hist.crossJoin(F.broadcast(scale)).withColumn("zz", (F.col("value") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)))
    w = F.exp(F.col("beta") * F.col("zz"))
    return z.select("*", F.explode(F.array(*map(F.lit, betas))).alias("beta")).groupBy("beta").agg((F.sum(w * F.col("ok")) / F.sum(w * F.col("c"))).alias("right"))
