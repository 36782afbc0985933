"""Linear models from sums over rows: ridge by left-out folds, logistic models by Newton steps, pairs within users.

Rows stay where they are: each step is one aggregation whose result is as wide as the features' products, for all folds at
once, and that is all the driver sees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: str) -> Column:
    """Null, NaN and infinite features as 0."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def linear(coefficients: np.ndarray, features: list[str]) -> Column:
    total = F.lit(0.0)
    for w, c in zip(coefficients, features):
        total = total + F.lit(float(w)) * clean(c)
    return total


def by_fold(folds: int, value) -> Column:
    """value(fold) of a row's own fold."""
    out = F.lit(None)
    for f in range(folds):
        out = F.when(F.col("fold") == f, value(f)).otherwise(out)
    return out


def crossfit_ridge(rows: DataFrame, features: list[str], target: Column, folds: int, alpha: float) -> tuple[np.ndarray, Column]:
    """The weights (fold, feature) of ridge regressions without intercept, each on all folds but one, and the prediction
    of a row by the weights of its own fold, which has not been learned from.

    The normal equations of all but one fold are those of all rows less the fold's own: one pass gives every fold's sums.
    """
    d = len(features)
    x = [clean(c) for c in features]
    sums = [F.sum(x[a] * x[b]).alias(f"x{a}_{b}") for a in range(d) for b in range(a, d)] + [F.sum(x[a] * target).alias(f"y{a}") for a in range(d)]
    gram, moment = np.zeros((folds, d, d)), np.zeros((folds, d))
    for r in rows.groupBy("fold").agg(*sums).collect():
        for a in range(d):
            moment[r["fold"], a] = r[f"y{a}"] or 0.0
            for b in range(a, d):
                gram[r["fold"], a, b] = gram[r["fold"], b, a] = r[f"x{a}_{b}"] or 0.0
    weights = np.array([np.linalg.solve(gram.sum(0) - gram[f] + alpha * np.eye(d), moment.sum(0) - moment[f]) for f in range(folds)])
    return weights, by_fold(folds, lambda f: linear(weights[f], features))


def anchored(rows: DataFrame, base: str, residual: Column, share: float) -> DataFrame:
    """rows with `score`: base and a share of the residual's standard score within the fold (population deviation)."""
    w = rows.withColumn("residual", residual).groupBy("fold").agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("sd"))
    z = F.when(F.col("sd") > 1e-12, (F.col("residual") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return rows.withColumn("residual", residual).join(F.broadcast(w), "fold").withColumn("score", F.col(base) + share * z).drop("mean", "sd")


def logistic_fit(rows: DataFrame, features: list[str], folds: int, strength: float = 0.5, balanced: bool = True, weight: Column | None = None, intercept: bool = True, rounds: int = 30) -> np.ndarray:
    """Coefficients (fold, features + intercept) of logistic models of `label`, each on all folds but one.

    Minimised is |w|^2 / 2 + strength * the sum of the rows' weighted losses, with features standardised over the fold's
    training rows and the intercept free; the coefficients are given for the features as they are. balanced: each label
    has half of all weight. A Newton step is one aggregation of gradients and Gram matrices for all folds.
    """
    d = len(features)
    x = [clean(c) for c in features]
    base = F.lit(1.0) if weight is None else weight
    inside = [F.col("fold") != f for f in range(folds)]
    each = lambda name, value: [F.sum(F.when(inside[f], value)).alias(f"{name}_{f}") for f in range(folds)]
    y = F.col("label").cast("double")
    first = rows.agg(*[s for a in range(d) for s in each(f"m{a}", x[a]) + each(f"q{a}", x[a] * x[a])], *each("n", F.lit(1.0)), *each("w", base), *each("p", base * y)).first()
    get = lambda name: np.array([first[f"{name}_{f}"] or 0.0 for f in range(folds)])
    n, whole, positive = get("n"), get("w"), get("p")
    mean = np.array([get(f"m{a}") / np.maximum(n, 1) for a in range(d)]).T.reshape(folds, d)
    sd = np.sqrt(np.maximum(np.array([get(f"q{a}") / np.maximum(n, 1) for a in range(d)]).T.reshape(folds, d) - mean**2, 0.0))
    sd[sd <= 1e-12] = 1.0
    if not intercept:
        mean = np.zeros_like(mean)
    up = whole / np.maximum(2 * positive, 1e-300) if balanced else np.ones(folds)
    down = whole / np.maximum(2 * (whole - positive), 1e-300) if balanced else np.ones(folds)
    size = d + intercept
    w = np.zeros((folds, size))
    penalty = np.diag([1.0] * d + [0.0] * intercept)
    for _ in range(rounds):
        sums = []
        for f in range(folds):
            z = [(x[a] - float(mean[f, a])) / float(sd[f, a]) for a in range(d)] + [F.lit(1.0)] * intercept
            score = sum((F.lit(float(w[f, a])) * z[a] for a in range(size)), F.lit(0.0))
            p = 1 / (1 + F.exp(-score))
            row = base * F.when(y > 0, float(up[f])).otherwise(float(down[f]))
            sums += [F.sum(F.when(inside[f], row * (y - p) * z[a])).alias(f"g{f}_{a}") for a in range(size)]
            sums += [F.sum(F.when(inside[f], row * p * (1 - p) * z[a] * z[b])).alias(f"h{f}_{a}_{b}") for a in range(size) for b in range(a, size)]
        r, most = rows.agg(*sums).first(), 0.0
        for f in range(folds):
            g = strength * np.array([r[f"g{f}_{a}"] or 0.0 for a in range(size)]) - penalty @ w[f]
            h = penalty + np.zeros((size, size))
            for a in range(size):
                for b in range(a, size):
                    h[a, b] = h[b, a] = penalty[a, b] + strength * (r[f"h{f}_{a}_{b}"] or 0.0)
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            w[f] += step
            most = max(most, np.abs(step).max())
        if most < 1e-10:
            break
    plain = w[:, :d] / sd
    return np.hstack([plain, (w[:, d] if intercept else np.zeros(folds))[:, None] - (plain * mean).sum(1)[:, None]])


def logistic_score(coefficients: np.ndarray, features: list[str]) -> Column:
    """The chance of label 1 by the model that hasn't seen the row's fold."""
    return by_fold(len(coefficients), lambda f: 1 / (1 + F.exp(-(linear(coefficients[f][:-1], features) + float(coefficients[f][-1])))))


def pair_differences(rows: DataFrame, features: list[str], most: int = 32) -> DataFrame:
    """u, fold, label and features: for each user up to `most` pairs of a positive and a negative row, in the order of
    their ids, as the difference with label 1 and its opposite with label 0. Users without both labels have none."""
    side = lambda y, name: rows.where(F.col("label") == y).select("u", "fold", F.col("id").alias(name), *[clean(c).alias(f"{c}_{name}") for c in features])
    # The first `most` of either kind are all that the first `most` pairs can hold.
    few = lambda df, name: df.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(name))).where(F.col("r") <= most).drop("r")
    pairs = few(side(1, "a"), "a").join(few(side(0, "b").drop("fold"), "b"), "u")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("a", "b"))).where(F.col("r") <= most)
    signed = pairs.withColumn("label", F.explode(F.array(F.lit(1), F.lit(0))))
    sign = 2 * F.col("label") - 1
    return signed.select("u", "fold", "label", *[(sign * (F.col(f"{c}_a") - F.col(f"{c}_b"))).alias(c) for c in features])
