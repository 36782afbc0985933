"""The frames that queries start from: interactions, a leak-free split, candidates and their base scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import split
from rankloom.session import materialise


class Base:
    """Frames over the tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: DataFrame | None = None
        self._held: DataFrame | None = None
        self._train: DataFrame | None = None
        self._candidates: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def interactions(self) -> DataFrame:
        """u, i, n, hours, hours_t, d (last date), early: one row for each user and item."""
        rows = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.to_date("o_orderdate").alias("d")).join(self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("i"), "l_quantity", "l_returnflag"), "o_orderkey")
        hours = F.sum("l_quantity")
        return rows.groupBy("u", "i").agg(F.count(F.lit(1)).alias("n"), hours.alias("hours"), F.log2(1 + hours).alias("hours_t"), F.max("d").alias("d"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("early"))

    def stored(self) -> DataFrame:
        """interactions(), joined and summed up once for all that a query makes of them."""
        if self._stored is None:
            self._stored = materialise(self.interactions(), "interactions")
        return self._stored

    def items(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("i"))

    def held(self) -> DataFrame:
        """The held-out interactions (u, i)."""
        if self._held is None:
            self._held = split.hold_out(self.stored(), seed="42:", order="hash")
        return self._held

    def train(self) -> DataFrame:
        """The interactions that aren't held out, written once; no negative is drawn for them."""
        if self._train is None:
            self._train = materialise(self.stored().join(self.held(), ["u", "i"], "left_anti"), "train")
        return self._train

    def candidates(self) -> DataFrame:
        """Labelled candidates (id, u, i, label): every user has as many unseen items as held-out ones."""
        if self._candidates is None:
            inter = self.stored()
            negatives = split.whole_negatives(split.hold_out_sizes(inter), self.items(), inter, seed="42n:")
            self._candidates = materialise(split.candidates(self.held(), negatives), "candidates")
        return self._candidates

    def split(self) -> tuple[DataFrame, DataFrame]:
        return self.train(), self.candidates()

    def popularity(self) -> DataFrame:
        """i, pop of all items: the users that hold an item in training, 0 for the others."""
        pops = self.train().groupBy("i").agg(F.count(F.lit(1)).alias("pop"))
        return self.items().distinct().join(pops, "i", "left").select("i", F.coalesce("pop", F.lit(0)).alias("pop"))

    def scored(self) -> DataFrame:
        """Candidates with s1 (popularity), s2 (closeness in time) and s3 (mean transformed hours), rounded so that
        no tie hangs on the order of a sum."""
        train, cand = self.split()
        day = F.unix_date("d")
        items = train.groupBy("i").agg(F.count(F.lit(1)).alias("pop"), F.avg(day).alias("day_i"), F.avg("hours_t").alias("mean_t"))
        users = train.groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.avg(day).alias("day_u"))
        rows = cand.join(items, "i", "left").join(users, "u", "left")
        pop = F.coalesce("pop", F.lit(0))
        return rows.select("id", "u", "i", "label", pop.alias("pop"), F.coalesce("deg", F.lit(0)).alias("deg"), F.round(F.log1p(pop), 9).alias("s1"), F.round(F.coalesce(-F.abs(F.col("day_u") - F.col("day_i")) / 365.0, F.lit(-10.0)), 9).alias("s2"), F.round(F.coalesce("mean_t", F.lit(0.0)), 9).alias("s3"))
