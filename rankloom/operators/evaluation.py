"""Evaluation of decoded predictions, gates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ranking


def evaluate(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n_rows, users, row_accuracy, user accuracy (mean, min, 5 %, 50 % and 95 %), users whose count of positives is right."""
    right = (F.col("pred") == F.col("label")).cast("int")
    users = rows.groupBy(*keys, "u").agg(F.avg(right).alias("acc"), F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"), (F.sum("pred") == F.sum("label")).alias("fits"))
    return users.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("users"), (F.sum("right") / F.sum("n")).alias("row_accuracy"), F.avg("acc").alias("user_mean"), F.min("acc").alias("user_min"), F.percentile("acc", 0.05).alias("user_p05"), F.percentile("acc", 0.5).alias("user_p50"), F.percentile("acc", 0.95).alias("user_p95"), F.count_if(F.col("fits")).alias("fitting_users"))


def long_axes(rows: DataFrame, scores: list[str]) -> DataFrame:
    """id, u, label, axis, score: a row for each score column."""
    return rows.select("id", "u", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("axis"), F.col(s).alias("score")) for s in scores])).alias("x")).select("id", "u", "label", "x.axis", "x.score")


def fix_break(rows: DataFrame, base: str, new: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """fixes, breaks, changed, delta of a prediction column against another."""
    right = {c: F.col(c) == F.col("label") for c in (base, new)}
    out = rows.groupBy(*keys).agg(F.count_if(~right[base] & right[new]).alias("fixes"), F.count_if(right[base] & ~right[new]).alias("breaks"), F.count_if(F.col(base) != F.col(new)).alias("changed"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("delta", (F.col("fixes") - F.col("breaks")) / F.col("n_rows"))


def mcnemar(fixes: Column, breaks: Column) -> Column:
    """Continuity-corrected statistic, clipped at 0; null without a discordant row."""
    gap = F.greatest(F.abs(fixes - breaks) - 1, F.lit(0))
    return gap * gap / F.nullif(fixes + breaks, F.lit(0))


def gate(rows: DataFrame, least_fixes: int, least_precision: float) -> DataFrame:
    """Adds verdict: promote, hold or reject, by fixes, breaks and precision."""
    precision = F.col("fixes") / F.nullif(F.col("fixes") + F.col("breaks"), F.lit(0))
    return rows.withColumn("verdict", F.when((F.col("fixes") > F.col("breaks")) & (F.col("fixes") >= least_fixes) & (precision >= least_precision), "promote").when(F.col("fixes") >= F.col("breaks"), "hold").otherwise("reject"))


def preflight(rows: DataFrame, label: str = "pred") -> DataFrame:
    """One row of counts: rows, ids, nulls, labels that aren't 0 or 1, positives, users without an even share."""
    users = rows.groupBy("u").agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isNull()).alias("missing"), F.count_if(~F.col(label).isin(0, 1)).alias("odd"))
    ids = rows.agg(F.count_distinct("id").alias("ids"))
    return users.agg(F.sum("n").alias("n_rows"), F.sum("missing").alias("missing"), F.sum("odd").alias("not_binary"), F.sum("p").alias("positives"), F.count_if(F.col("p") != F.floor(F.col("n") / 2)).alias("uneven_users")).crossJoin(ids)


def integrity(rows: DataFrame, scores: list[str]) -> DataFrame:
    """axis, n_rows, bad (null, NaN or infinite), values (distinct), thin (fewer than 100 values)."""
    rows = long_axes(rows, scores)
    s = F.col("score")
    out = rows.groupBy("axis").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad"), F.count_distinct("score").alias("values"))
    return out.withColumn("thin", (F.col("values") < 100).cast("int"))


def overlaps(changed: DataFrame) -> DataFrame:
    """a, b, common, jaccard for each pair of sets in (name, id); the names are few, the ids are not."""
    sizes = changed.groupBy("name").agg(F.count_distinct("id").alias("n"))
    one, other = changed.select(F.col("name").alias("a"), "id").distinct(), changed.select(F.col("name").alias("b"), "id").distinct()
    both = one.join(other, "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    pairs = sizes.select(F.col("name").alias("a"), F.col("n").alias("n_a")).join(F.broadcast(sizes.select(F.col("name").alias("b"), F.col("n").alias("n_b"))), F.col("a") < F.col("b"))
    out = pairs.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("a", "b", "common", (F.col("common") / F.nullif(F.col("n_a") + F.col("n_b") - F.col("common"), F.lit(0))).alias("jaccard"))


def decoded_axes(rows: DataFrame, scores: list[str]) -> DataFrame:
    """long_axes with pred of each axis: one shuffle by (axis, user)."""
    return ranking.top_half(long_axes(rows, scores), "score", keys=("axis", "u"))


def tiers(counts: DataFrame, floor: float, alike: float) -> DataFrame:
    """Adds tier to rows with fixes, breaks, acc and c, the correlation with the base: 'below floor', 'too alike', 'noise'
    (a net change within two deviations of that of a fair coin), 'strict' or 'worse'."""
    net, changed = F.col("fixes") - F.col("breaks"), F.col("fixes") + F.col("breaks")
    tier = F.when(F.col("acc") < floor, "below floor").when(F.abs("c") > alike, "too alike").when(F.abs(net) <= 2 * F.sqrt(changed), "noise").when(net > 0, "strict").otherwise("worse")
    return counts.withColumn("tier", tier)
