"""Per-user windows: ranks, standard scores, top-half decoding, boundaries and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import stats

LOWEST = -1e30


def sane(score: str | Column) -> Column:
    """Null, NaN and infinite scores as -1e30, so that they come last."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(LOWEST)).otherwise(s)


def by_user(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("u",)))


def position(score: str | Column, *keys: str, ties: str = "id") -> Column:
    """1 for the highest score of a user; ties by id upwards."""
    return F.row_number().over(by_user(*keys).orderBy(sane(score).desc(), F.col(ties)))


def rank_high(score: str | Column, *keys: str) -> Column:
    """0 for the lowest score of a user; ties by id upwards."""
    return F.row_number().over(by_user(*keys).orderBy(sane(score), F.col("id"))) - 1


def average_rank(score: str, *keys: str) -> Column:
    """Rank from the lowest, with the mean rank for ties."""
    s = sane(score)
    return F.rank().over(by_user(*keys).orderBy(s)) + (F.count(F.lit(1)).over(Window.partitionBy(*(keys or ("u",)), s)) - 1) / 2


def percent_rank(score: str, *keys: str) -> Column:
    """(position from the lowest - 1) / (n - 1); 0 for a lone row."""
    n = F.count(F.lit(1)).over(by_user(*keys))
    return F.when(n > 1, rank_high(score, *keys) / F.nullif(n - 1, F.lit(0))).otherwise(0.0)


def z(score: str | Column, *keys: str, mode: str = "samp") -> Column:
    """Standard score within the group. samp: sample deviation, 0 where it is below 1e-12 or the row is alone; pop: the
    population's; samp_unit: sample deviation, taken as 1 where it is 0."""
    s = sane(score)
    w = by_user(*keys)
    mean = F.avg(s).over(w)
    sd = (F.stddev_pop(s) if mode == "pop" else F.stddev_samp(s)).over(w)
    if mode == "samp_unit":
        return (s - mean) / F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 1.0).otherwise(sd)
    return F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise((s - mean) / F.when(sd >= 1e-12, sd))


def top_half(rows: DataFrame, score: str | Column, k: str = "half", keys: tuple[str, ...] = ("u",), pred: str = "pred", pos: str = "rank_in_user") -> DataFrame:
    """Adds rank_in_user, k_in_user and pred. k: 'half' takes floor(n / 2) rows, 'label' as many as the user's labels say."""
    if k not in ("half", "label"):
        raise ValueError("k must be 'half' or 'label'")
    w = by_user(*keys)
    size = F.floor(F.count(F.lit(1)).over(w) / 2).cast("long") if k == "half" else F.sum("label").over(w)
    out = rows.withColumn(pos, position(score, *keys)).withColumn("k_in_user", size)
    return out.withColumn(pred, (F.col(pos) <= F.col("k_in_user")).cast("int"))


def with_boundary(rows: DataFrame, score: str, k: str = "half", keys: tuple[str, ...] = ("u",)) -> DataFrame:
    """top_half and boundary_distance |rank - (k + 1/2)|, margin score[k] - score[k + 1] (null where k is 0 or n)."""
    out = top_half(rows, score, k, keys)
    w = by_user(*keys)
    s = sane(score)
    at = lambda shift: F.max(F.when(F.col("rank_in_user") == F.col("k_in_user") + shift, s)).over(w)
    return out.withColumn("boundary_distance", F.abs(F.col("rank_in_user") - (F.col("k_in_user") + 0.5))).withColumn("margin", F.when(F.col("k_in_user") > 0, at(0) - at(1)))


def quantile_bin(order: list[Column], q: int, *keys: str) -> Column:
    """Equal-count bins 0..q-1 of ranks within the keys: greatest(0, ceil(q (r - 1) / (n - 1)) - 1)."""
    w = Window.partitionBy(*keys)
    r, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return F.greatest(F.lit(0), F.when(n > 1, F.ceil(q * (r - 1) / F.nullif(n - 1, F.lit(0))) - 1).otherwise(0)).cast("int")


def binned_counts(rows: DataFrame, value: str, q: int) -> DataFrame:
    """Equal-count bins 0..q-1 of all rows by (value, i), whose pairs are distinct; ranks are running counts."""
    ranked = stats.prefix_sums(rows.withColumns({"one": F.lit(1), "place": F.struct(value, "i")}), "place", ["one"])
    out = ranked.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))
    return out.withColumn("bin", F.greatest(F.lit(0), F.when(F.col("total") > 1, F.ceil(q * F.col("one_before") / F.nullif(F.col("total") - 1, F.lit(0))) - 1).otherwise(0)).cast("int")).drop("one", "place", "one_before", "total")


def in_band(width: int) -> Column:
    """Rows at most `width` places from the boundary, on either side."""
    return (F.col("rank_in_user") > F.col("k_in_user") - width) & (F.col("rank_in_user") <= F.col("k_in_user") + width)
