"""Choosing among variants of a prediction by the rows that they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialise

CHOSEN = "step int, name string, n_changed long, gain double"


def choose(changed: DataFrame, most: int, least_apart: int, worth: Column | None = None, barred: tuple[str, ...] = (), prior: tuple[str, ...] = (), batch: int = 16) -> DataFrame:
    """step, name, n_changed, gain: at most `most` variants, each the one that adds most to those before it.

    changed: name, id, a row for each row that a variant predicts otherwise than the common base; repeated rows count once,
    and so do nulls as a name (left out). A variant's gain is the worth (1 by default; negative or null worths count as 0)
    of the ids that no earlier choice changes, rounded to six places, ties to the smaller name. Variants in `prior` are taken
    as chosen before the first step and don't come out; those in `barred` are never chosen. A variant that differs from an
    earlier choice, or a prior one, in fewer than `least_apart` rows is passed over. Steps end when no gain is left.

    Gains only fall as choices are made, so an old gain is a bound: each step refreshes the variants with the highest bounds,
    `batch` at a time, in one job, and stops when a fresh gain is ahead of all bounds. The driver holds a few numbers for
    each variant; ids stay in tables.
    """
    value = F.lit(1.0) if worth is None else F.greatest(F.coalesce(worth.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = changed.where(F.col("name").isNotNull() & F.col("id").isNotNull()).groupBy("name", "id").agg(F.max(value).alias("worth"))
    rows = materialise(rows, "changed")
    sums = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("worth"), 6).alias("gain")).collect()
    sizes, bounds, fresh = {r["name"]: r["n"] for r in sums}, {r["name"]: r["gain"] for r in sums}, set()
    open_ = set(bounds) - set(barred) - set(prior)

    def apart_from(name: str) -> set[str]:
        """The open variants that are far enough from one."""
        own = rows.where(F.col("name") == name).select("id")
        common = {r["name"]: r["n"] for r in rows.join(own, "id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {v for v in open_ if sizes[v] + sizes.get(name, 0) - 2 * common.get(v, 0) >= least_apart}

    before, out = [p for p in prior if p in sizes], []
    for name in before:
        open_ = apart_from(name)
    if not before:
        fresh = set(open_)
    while open_ and len(out) < most:
        order = sorted(open_, key=lambda v: (-bounds[v], v))
        if order[0] not in fresh:
            stale = [v for v in order if v not in fresh][:batch]
            covered = rows.where(F.col("name").isin(before)).select("id").distinct()
            left = rows.where(F.col("name").isin(stale)).join(covered, "id", "left_anti")
            gains = {r["name"]: r["gain"] for r in left.groupBy("name").agg(F.round(F.sum("worth"), 6).alias("gain")).collect()}
            bounds |= {v: gains.get(v, 0.0) for v in stale}
            fresh |= set(stale)
            continue
        best = order[0]
        if bounds[best] <= 0:
            break
        out.append((len(out) + 1, best, sizes[best], bounds[best]))
        before.append(best)
        open_.discard(best)
        open_, fresh = apart_from(best), set()
    return changed.sparkSession.createDataFrame(out, CHOSEN)
