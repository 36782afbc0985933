"""Distribution statistics as aggregations."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialise


def prefix_sums(rows: DataFrame, value: str, sums: list[str], keys: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """rows with <sum>_before: the sums over the rows of the same keys with smaller (or larger) values, which are distinct.

    Rows are dealt into ranges of the values; each range is summed up, the ranges' own sums are added up in a table of
    their number, and within a range a window does the rest. So no task sees more than one range.
    """
    order = [*[F.col(k) for k in keys], F.col(value).desc() if descending else F.col(value)]
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    whole = ranged.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"{c}_part") for c in sums])
    above = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*keys, "part", *[F.coalesce(F.sum(f"{c}_part").over(above), F.lit(0)).alias(f"{c}_base") for c in sums])
    inside = Window.partitionBy(*keys, "part").orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(base, [*keys, "part"])
    return out.select(*rows.columns, *[(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums])


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: n, mean, population deviation, min, max and exact, interpolated percentiles."""
    plain = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return plain.crossJoin(F.broadcast(quantiles(rows, {f"p{round(100 * p):02d}": (value, p) for p in points})))


def quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with the exact, interpolated percentile of each (column, point), nulls left out.

    Taken from the columns' histograms with running counts: no task holds all values.
    """
    out = None
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        hist = prefix_sums(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c")), value, ["c"])
        total = hist.agg(F.sum("c").alias("total"))
        found = []
        for name, (v, p) in wanted.items():
            if v == value:
                at = (F.col("total") - 1) * p
                low, high = (F.max(F.when(F.col("c_before") <= x(at), F.col(value).cast("double"))) for x in (F.floor, F.ceil))
                part = F.max(at - F.floor(at))
                found.append((low + (high - low) * part).alias(name))
        one = hist.crossJoin(F.broadcast(total)).agg(*found)
        out = one if out is None else out.crossJoin(one)
    return out


def running(hist: DataFrame, value: str, count: str, descending: bool = False) -> DataFrame:
    """A histogram with the running sum of counts (upto) and their total."""
    summed = prefix_sums(hist, value, [count], descending=descending).withColumn("upto", F.col(f"{count}_before") + F.col(count)).drop(f"{count}_before")
    return summed.crossJoin(F.broadcast(hist.agg(F.sum(count).alias("total"))))


def gini(rows: DataFrame, value: str) -> DataFrame:
    """gini: 2 sum(i x_i) / (n sum x) - (n + 1) / n over values in ascending order, from their histogram."""
    hist = prefix_sums(rows.groupBy(value).agg(F.count(F.lit(1)).alias("c")), value, ["c"])
    # c equal values take ranks c_before + 1 .. c_before + c
    ranks = F.col("c") * (2 * F.col("c_before") + F.col("c") + 1) / 2
    sums = hist.agg(F.sum(ranks * F.col(value)).alias("a"), F.sum(F.col("c") * F.col(value)).alias("b"), F.sum("c").alias("n"))
    return sums.select((F.when(F.col("b") > 0, 2 * F.col("a") / F.nullif(F.col("n") * F.col("b"), F.lit(0.0)) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)).alias("gini"))


def ks(rows: DataFrame, value: str, side: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, ks: the largest gap of the two cumulative shares; side: a boolean column."""
    hist = prefix_sums(rows.groupBy(*keys, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b")), value, ["a", "b"], keys)
    total = hist.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = hist.join(total, list(keys)) if keys else hist.crossJoin(F.broadcast(total))
    gap = (F.col("a_before") + F.col("a")) / F.col("na") - (F.col("b_before") + F.col("b")) / F.col("nb")
    return both.groupBy(*keys).agg(F.max(F.abs(gap)).alias("ks"))


def auc(rows: DataFrame, score: str, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, auc: the chance that a positive is above a negative, ties counting half, from counts by score."""
    return auc_of_counts(rows.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("m")), score, keys)


def auc_of_counts(hist: DataFrame, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, auc of the numbers of positives p and negatives m at each score."""
    hist = prefix_sums(hist, score, ["m"], keys)
    sums = hist.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("m_before") + F.col("m") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    return sums.select(*keys, (F.col("wins") / F.nullif(F.col("p") * F.col("m"), F.lit(0))).alias("auc"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's, null where a side doesn't vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def residual(rows: DataFrame, y: str, x: str) -> DataFrame:
    """y less its least-squares line on x, as column residual."""
    line = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return rows.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).drop("slope", "intercept")


def residual_of_two(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """y less its least-squares plane on a and b, as column residual, from covariances."""
    cov = lambda p, q, n: F.covar_pop(p, q).alias(n)
    c = rows.agg(cov(a, a, "aa"), cov(b, b, "bb"), cov(a, b, "ab"), cov(y, a, "ya"), cov(y, b, "yb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"))
    x = {n: F.col(n) for n in c.columns}
    size = F.nullif(x["aa"] * x["bb"] - x["ab"] * x["ab"], F.lit(0.0))
    on_a, on_b = (x["ya"] * x["bb"] - x["yb"] * x["ab"]) / size, (x["yb"] * x["aa"] - x["ya"] * x["ab"]) / size
    return rows.crossJoin(F.broadcast(c)).withColumn("residual", F.col(y) - x["my"] - on_a * (F.col(a) - x["ma"]) - on_b * (F.col(b) - x["mb"])).drop(*c.columns)


def binomial_two_sided(fixes: int, breaks: int) -> float:
    """Exact two-sided p of a fair coin, by whole numbers."""
    n, k = fixes + breaks, min(fixes, breaks)
    tail, term = 0, 1
    for i in range(k + 1):
        tail += term
        term = term * (n - i) // (i + 1)
    return float(min(Fraction(1), Fraction(2 * tail, 2**n)))


def chi_square_survival(x: float, pairs: int) -> float:
    """Survival of a chi-square variable with 2 * pairs degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(pairs))


def fisher_combined(ps: list[float]) -> float:
    return chi_square_survival(-2 * sum(math.log(max(p, 1e-300)) for p in ps), len(ps)) if ps else 1.0


def mcnemar_p(fixes: int, breaks: int) -> float:
    """p of the continuity-corrected statistic, clipped at 0."""
    n = fixes + breaks
    return math.erfc(math.sqrt(max(abs(fixes - breaks) - 1, 0) ** 2 / n / 2)) if n else 1.0


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight places further on, right to about 1e-12."""
    z = x + F.lit(8.0)
    product = x.cast("double")
    for k in range(1, 8):
        product = product * (x + F.lit(float(k)))
    series = F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3)) + F.lit(1 / 1260) / F.pow(z, F.lit(5)) - F.lit(1 / 1680) / F.pow(z, F.lit(7))
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def binomial_p(fixes: Column, breaks: Column) -> Column:
    """Exact two-sided p of a fair coin, as a column.

    The largest term of the smaller tail comes from log_gamma, the others from their ratios to it. Terms fall faster than
    exp(-2 j^2 / n) with the distance j, so 10 sqrt(n) + 100 of them leave out nothing that a double could hold.
    """
    n, k = (fixes + breaks).cast("double"), F.least(fixes, breaks).cast("double")
    head = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    steps = F.sequence(F.lit(0), F.least(k, F.floor(10 * F.sqrt(n)) + 100).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    tail = F.aggregate(steps, start, lambda s, j: F.struct((s["term"] * (k - j) / (n - k + j + 1)).alias("term"), (s["total"] + s["term"]).alias("total")), lambda s: s["total"])
    return F.least(F.lit(1.0), 2 * F.exp(head + F.log(tail)))


def normal_tails(x: Column) -> Column:
    """erfc(x) for x >= 0: a series of positive terms below 2.5, a continued fraction from there."""
    start = F.struct(x.alias("term"), F.lit(0.0).alias("total"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda s, m: F.struct((s["term"] * 2 * x * x / (2 * m + 1)).alias("term"), (s["total"] + s["term"]).alias("total")), lambda s: s["total"])
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.greatest(x, F.lit(1.0)), lambda f, m: x + m / 2.0 / f)
    bell = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.5, F.greatest(1 - 2 * bell * near, F.lit(0.0))).otherwise(bell / F.greatest(below, F.lit(1.0)))


def mcnemar_chance(fixes: Column, breaks: Column) -> Column:
    """p of the continuity-corrected statistic, clipped at 0; 1 without a discordant row."""
    n = (fixes + breaks).cast("double")
    gap = F.greatest(F.abs(fixes - breaks) - 1, F.lit(0)).cast("double")
    return F.when(n > 0, normal_tails(F.sqrt(gap * gap / F.greatest(n, F.lit(1.0)) / 2))).otherwise(1.0)


def fisher(rows: DataFrame, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, tests, chi_square, combined: Fisher's combination of a group's p values, which are held between 1e-300 and 1.

    A sum for each group, so its tests may be any number; nulls are left out, and no test at all gives 1.
    """
    logs = F.log(F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1.0)))
    out = rows.groupBy(*keys).agg(F.count(p).alias("tests"), F.coalesce(-2 * F.sum(logs), F.lit(0.0)).alias("chi_square"))
    half = F.col("chi_square") / 2
    # Terms of exp(-x) x^j / j!, by their logarithms.
    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.col("tests").cast("int"), F.lit(1))), lambda j: (j - 1) * F.log(F.greatest(half, F.lit(1e-300))) - half - log_gamma(j.cast("double")))
    chance = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.exp(t))
    return out.withColumn("combined", F.when((F.col("tests") == 0) | (F.col("chi_square") == 0), 1.0).otherwise(F.least(chance, F.lit(1.0))))
