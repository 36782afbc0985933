"""Ranking, fusion and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import evaluation, fusion, ranking, stats, variants
from rankloom.plans.base import Base
from rankloom.plans.registry import query

r6 = lambda c: F.round(c, 6)
S = ["s1", "s2", "s3"]
BAND = "r1 > k - {n} AND r1 <= k + {n}"


@query("m02_popularity_scores", ", m AS (SELECT u, avg(pop) AS mu, quantile_cont(pop, 0.5) AS md, greatest(coalesce(stddev_samp(pop), 1), 1) AS sd FROM train JOIN ipop USING (i) GROUP BY u) SELECT id, s1, round(sqrt(base.pop), 6) AS root, round((base.pop - mu) / sd, 6) AS above, round(-abs(base.pop - md) / sd, 6) AS near FROM base JOIN m USING (u)")
def popularity_scores(b: Base) -> DataFrame:
    train = b.train()
    pops = train.join(train.groupBy("i").agg(F.count(F.lit(1)).alias("p")), "i")
    users = pops.groupBy("u").agg(F.avg("p").alias("mu"), F.percentile("p", 0.5).alias("md"), F.greatest(F.coalesce(F.stddev_samp("p"), F.lit(1.0)), F.lit(1.0)).alias("sd"))
    return b.scored().join(users, "u").select("id", "s1", r6(F.sqrt("pop")).alias("root"), r6((F.col("pop") - F.col("mu")) / F.col("sd")).alias("above"), r6(-F.abs(F.col("pop") - F.col("md")) / F.col("sd")).alias("near"))


@query("w08_tophalf_decode", "SELECT id, u, i, label, r1 AS rank_in_user, k AS k_in_user, p1 AS pred FROM preds")
def tophalf_decode(b: Base) -> DataFrame:
    return ranking.top_half(b.scored(), "s1").select("id", "u", "i", "label", "rank_in_user", "k_in_user", "pred")


@query("w08_label_decode", "SELECT id, CAST(r2 <= sum(label) OVER (PARTITION BY u) AS INT) AS pred FROM preds")
def label_decode(b: Base) -> DataFrame:
    return ranking.top_half(b.scored(), "s2", "label").select("id", "pred")


EVAL = """SELECT {k} CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS users, round(sum(r) / sum(n), 6) AS row_accuracy, round(avg(acc), 6) AS user_mean, round(min(acc), 6) AS user_min, round(quantile_cont(acc, 0.05), 6) AS user_p05,
  round(quantile_cont(acc, 0.5), 6) AS user_p50, round(quantile_cont(acc, 0.95), 6) AS user_p95, count_if(fits) AS fitting_users FROM ({src}) {g}"""
USERS = "SELECT u, avg(CAST({p} = label AS INT)) AS acc, sum(CAST({p} = label AS INT)) AS r, count(*) AS n, sum({p}) = sum(label) AS fits FROM preds GROUP BY u"


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query("e01_evaluate_tophalf", EVAL.format(k="", src=USERS.format(p="p1"), g=""))
def evaluate_tophalf(b: Base) -> DataFrame:
    return rounded(evaluation.evaluate(ranking.top_half(b.scored(), "s1")))


@query("e02_evaluate_many", EVAL.format(k="axis,", src=" UNION ALL ".join(f"SELECT 's{n}' AS axis, * FROM ({USERS.format(p=f'p{n}')})" for n in (1, 2, 3)), g="GROUP BY axis"))
def evaluate_many(b: Base) -> DataFrame:
    return rounded(evaluation.evaluate(evaluation.decoded_axes(b.scored(), S), ("axis",)))


@query("s13_submission", "SELECT id AS ID, p1 AS Label FROM preds")
def submission(b: Base) -> DataFrame:
    return ranking.top_half(b.scored(), "s1").select(F.col("id").alias("ID"), F.col("pred").alias("Label"))


@query("w01_row_number", "SELECT id, r1, r2, r3 FROM preds")
def row_numbers(b: Base) -> DataFrame:
    return b.scored().select("id", *[ranking.position(s).alias(f"r{s[1]}") for s in S])


@query("w02_average_rank", "SELECT id, rank() OVER (PARTITION BY u ORDER BY s1) + (count(*) OVER (PARTITION BY u, s1) - 1) / 2 AS r FROM base")
def average_rank(b: Base) -> DataFrame:
    return b.scored().select("id", ranking.average_rank("s1").alias("r"))


@query("w03_percent_rank", "SELECT id, round((row_number() OVER (PARTITION BY u ORDER BY s1, id) - 1) / (count(*) OVER (PARTITION BY u) - 1), 6) AS r FROM base")
def percent_rank(b: Base) -> DataFrame:
    return b.scored().select("id", r6(ranking.percent_rank("s1")).alias("r"))


Z = "coalesce((s{n} - avg(s{n}) OVER (PARTITION BY u)) / CASE WHEN {f}(s{n}) OVER (PARTITION BY u) >= 1e-12 THEN {f}(s{n}) OVER (PARTITION BY u) END, 0.0)"
ZS = ", zs AS (SELECT *, " + ", ".join(f"{Z.format(n=n, f='stddev_samp')} AS z{n}" for n in (1, 2, 3)) + " FROM preds)"


@query("w04_z_sample", ZS + " SELECT id, " + ", ".join(f"round(z{n}, 6) AS z{n}" for n in (1, 2, 3)) + " FROM zs")
def z_sample(b: Base) -> DataFrame:
    return b.scored().select("id", *[r6(ranking.z(s)).alias(f"z{s[1]}") for s in S])


@query("w05_z_population", "SELECT id, " + ", ".join(f"round({Z.format(n=n, f='stddev_pop')}, 6) AS z{n}" for n in (1, 2, 3)) + " FROM preds")
def z_population(b: Base) -> DataFrame:
    return b.scored().select("id", *[r6(ranking.z(s, mode="pop")).alias(f"z{s[1]}") for s in S])


@query("w06_group_size", "SELECT id, count(*) OVER (PARTITION BY u) AS n FROM base")
def group_size(b: Base) -> DataFrame:
    return b.candidates().select("id", F.count(F.lit(1)).over(ranking.by_user()).alias("n"))


@query("w07_rank_high", "SELECT id, row_number() OVER (PARTITION BY u ORDER BY s3, id) - 1 AS r FROM base")
def rank_high(b: Base) -> DataFrame:
    return b.scored().select("id", ranking.rank_high("s3").alias("r"))


@query("w09_boundary_distance", "SELECT id, abs(r1 - (k + 0.5)) AS distance, CAST(abs(r1 - (k + 0.5)) <= 1 AS INT) AS near FROM preds")
def boundary_distance(b: Base) -> DataFrame:
    return ranking.with_boundary(b.scored(), "s1").select("id", F.col("boundary_distance").alias("distance"), (F.col("boundary_distance") <= 1).cast("int").alias("near"))


@query("w10_boundary_margin", "SELECT u, round(max(CASE WHEN r1 = k THEN s1 END) - max(CASE WHEN r1 = k + 1 THEN s1 END), 6) AS margin FROM preds GROUP BY u")
def boundary_margin(b: Base) -> DataFrame:
    return ranking.with_boundary(b.scored(), "s1").groupBy("u").agg(r6(F.max("margin")).alias("margin"))


@query("w13_recent_decay", "SELECT u, i, age, round(pow(0.85, age), 6) AS w FROM (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY d DESC, i DESC) - 1 AS age FROM train) WHERE age < 20")
def recent_decay(b: Base) -> DataFrame:
    age = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("d"), F.desc("i"))) - 1
    return b.train().select("u", "i", age.alias("age")).where("age < 20").withColumn("w", r6(F.pow(F.lit(0.85), "age")))


PCT = "(rank() OVER (PARTITION BY {k} ORDER BY hours) + (count(*) OVER (PARTITION BY {k}, hours) - 1) / 2) / count(*) OVER (PARTITION BY {k})"


@query("w15_confidence", f"SELECT u, i, round(0.5 + 0.5 * {PCT.format(k='u')}, 6) AS by_user, round(0.5 + 0.5 * {PCT.format(k='i')}, 6) AS by_item, round(0.5 + 0.25 * {PCT.format(k='u')} + 0.25 * {PCT.format(k='i')}, 9) AS both FROM train")
def confidence(b: Base) -> DataFrame:
    def pct(k: str):
        return ranking.average_rank("hours", k) / F.count(F.lit(1)).over(Window.partitionBy(k))

    rows = b.train().select("u", "i", pct("u").alias("of_user"), pct("i").alias("of_item"))
    part = lambda c: r6(0.5 + 0.5 * F.col(c))
    return rows.select("u", "i", part("of_user").alias("by_user"), part("of_item").alias("by_item"), F.round(0.5 + 0.25 * F.col("of_user") + 0.25 * F.col("of_item"), 9).alias("both"))


@query("w16_boundary_band", f"SELECT id, r1 FROM preds WHERE {BAND.format(n=2)}")
def boundary_band(b: Base) -> DataFrame:
    return ranking.top_half(b.scored(), "s1").where(ranking.in_band(2)).select("id", F.col("rank_in_user").alias("r1"))


@query("w17_pseudo_edges", "SELECT u, i, round(s1 - edge, 6) AS margin FROM (SELECT *, max(CASE WHEN r1 = k + 1 THEN s1 END) OVER (PARTITION BY u) AS edge FROM preds) WHERE r1 <= 2 AND r1 <= k AND s1 > edge")
def pseudo_edges(b: Base) -> DataFrame:
    rows = ranking.top_half(b.scored(), "s1")
    edge = F.max(F.when(F.col("rank_in_user") == F.col("k_in_user") + 1, F.col("s1"))).over(ranking.by_user())
    return rows.withColumn("edge", edge).where("rank_in_user <= 2 and pred = 1 and s1 > edge").select("u", "i", r6(F.col("s1") - F.col("edge")).alias("margin"))


@query("w18_sequences", "SELECT u, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY r DESC) AS tail, CAST(greatest(0, 10 - count(*)) AS INT) AS pad FROM (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY d DESC, i DESC) AS r FROM train) WHERE r <= 10 GROUP BY u")
def sequences(b: Base) -> DataFrame:
    last = b.train().withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("d"), F.desc("i")))).where("r <= 10")
    return last.groupBy("u").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "i")), False), lambda x: x["i"].cast("string")), " ").alias("tail"), F.greatest(F.lit(0), 10 - F.count(F.lit(1))).cast("int").alias("pad"))


@query("k02_recent_head", "SELECT u, i, d FROM (SELECT u, i, d, row_number() OVER (PARTITION BY u ORDER BY d DESC, i) AS r FROM inter) WHERE r <= 3")
def recent_head(b: Base) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("d"), "i"))
    return b.interactions().withColumn("r", r).where("r <= 3").select("u", "i", "d")


@query("k04_global_top", "SELECT i, count(*) AS pop FROM inter GROUP BY i ORDER BY pop DESC, i LIMIT 100")
def global_top(b: Base) -> DataFrame:
    return b.interactions().groupBy("i").agg(F.count(F.lit(1)).alias("pop")).orderBy(F.desc("pop"), "i").limit(100)


@query("b01_mean_median_z", ZS + " SELECT id, round((z1 + z2 + z3) / 3, 6) AS mean_z, round(list_sort([z1, z2, z3])[2], 6) AS median_z FROM zs")
def mean_median_z(b: Base) -> DataFrame:
    z = [f"z_{s}" for s in S]
    return fusion.with_z(b.scored(), S).select("id", r6(fusion.mean_of(z)).alias("mean_z"), r6(fusion.median_of(z)).alias("median_z"))


@query("b02_rrf", "SELECT id, round((r1 + r2 + r3) / 3, 6) AS mean_rank, CAST(list_sort([r1, r2, r3])[2] AS DOUBLE) AS median_rank, " + ", ".join(f"round(1 / ({k} + r1) + 1 / ({k} + r2) + 1 / ({k} + r3), 6) AS rrf{k}" for k in (1, 5, 10, 60)) + " FROM preds")
def rrf(b: Base) -> DataFrame:
    r = ["r1", "r2", "r3"]
    rows = b.scored().withColumns({f"r{s[1]}": ranking.position(s) for s in S})
    return rows.select("id", r6(fusion.mean_of(r)).alias("mean_rank"), fusion.median_of(r).alias("median_rank"), *[r6(fusion.reciprocal_rank(r, k)).alias(f"rrf{k}") for k in (1, 5, 10, 60)])


@query("b03_weighted_z", ZS + " SELECT id, round(0.5 * z1 + 0.3 * z2 + 0.2 * z3, 6) AS blend FROM zs")
def weighted_z(b: Base) -> DataFrame:
    return fusion.with_z(b.scored(), S).select("id", r6(fusion.weighted({"z_s1": 0.5, "z_s2": 0.3, "z_s3": 0.2})).alias("blend"))


@query("b04_rank_sum", "SELECT id, a + b AS rank_sum, CAST(row_number() OVER (PARTITION BY u ORDER BY a + b DESC, id) <= k AS INT) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s1, id) - 1 AS a, row_number() OVER (PARTITION BY u ORDER BY s2, id) - 1 AS b FROM preds)")
def rank_sum(b: Base) -> DataFrame:
    rows = b.scored().withColumns({"a": ranking.rank_high("s1"), "b": ranking.rank_high("s2")}).withColumn("rank_sum", F.col("a") + F.col("b"))
    return ranking.top_half(rows, F.col("rank_sum").cast("double")).select("id", "rank_sum", "pred")


@query("b05_raw_mean", "SELECT id, round((s1 + s2 + s3) / 3, 6) AS mean FROM base")
def raw_mean(b: Base) -> DataFrame:
    return b.scored().select("id", r6(fusion.mean_of(S)).alias("mean"))


@query("b06_lcb_ucb", ZS + ", q AS (SELECT *, (z1 + z2 + z3) / 3 AS m, sqrt((pow(z1 - (z1 + z2 + z3) / 3, 2) + pow(z2 - (z1 + z2 + z3) / 3, 2) + pow(z3 - (z1 + z2 + z3) / 3, 2)) / 3) AS sd FROM zs) SELECT id, round(m - 0.5 * sd, 6) AS lcb, round(m + 0.5 * sd, 6) AS ucb FROM q")
def lcb_ucb(b: Base) -> DataFrame:
    z = [f"z_{s}" for s in S]
    rows = fusion.with_z(b.scored(), S)
    return rows.select("id", r6(fusion.mean_of(z) - 0.5 * fusion.deviation_of(z)).alias("lcb"), r6(fusion.mean_of(z) + 0.5 * fusion.deviation_of(z)).alias("ucb"))


@query("b07_vote", "SELECT id, p1 + p2 + p3 AS votes, CAST(row_number() OVER (PARTITION BY u ORDER BY p1 + p2 + p3 DESC, r1) <= k AS INT) AS pred FROM preds")
def vote(b: Base) -> DataFrame:
    rows = fusion.votes(b.scored(), S).withColumn("r1", ranking.position("s1"))
    voted = F.col("votes") - F.col("r1") / 1000.0
    return ranking.top_half(rows, voted).select("id", "votes", "pred")


VOTED = "CASE WHEN r1 <= k - w THEN 10.0 WHEN r1 > k + w THEN -10.0 ELSE p2 + p3 END"


@query("b08_boundary_vote", f"SELECT id, CAST({VOTED} AS DOUBLE) AS voted FROM (SELECT *, greatest(3, least(20, ceil(deg * 0.1))) AS w FROM preds)")
def boundary_vote(b: Base) -> DataFrame:
    return fusion.boundary_votes(b.scored(), "s1", ["s2", "s3"]).select("id", "voted")


RESCORE = f"CASE WHEN {BAND.format(n=2)} THEN (z1 + z2) / 2 ELSE z1 END"


@query("b09_boundary_rescore", ZS + f" SELECT id, round({RESCORE}, 6) AS rescored FROM zs")
def boundary_rescore(b: Base) -> DataFrame:
    return fusion.band_rescored(b.scored(), "s1", "s2", 2).select("id", r6(F.col("rescored")).alias("rescored"))


GRID = ", zp AS (SELECT *, " + ", ".join(f"{Z.format(n=n, f='stddev_pop')} AS z{n}" for n in (1, 2)) + """ FROM preds), g AS (
  SELECT *, row_number() OVER (PARTITION BY w, band, u ORDER BY round(z1 + CASE WHEN r1 > k - band AND r1 <= k + band THEN w * z2 ELSE 0 END, 9) DESC, id) <= k AS pn
  FROM zp CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS w) CROSS JOIN (SELECT unnest([1, 2]) AS band))"""


@query("b10_residual_grid", GRID + " SELECT w, band, count_if(p1 <> label AND pn::INT = label) AS fixes, count_if(p1 = label AND pn::INT <> label) AS breaks, count_if(p1 <> pn::INT) AS changed FROM g GROUP BY 1, 2")
def residual_grid(b: Base) -> DataFrame:
    rows = fusion.residual_grid(b.scored(), "s1", "s2", [0.1, 0.3, 0.5], [1, 2])
    return evaluation.fix_break(ranking.top_half(rows, "fused", keys=("w", "band", "u")), "base_pred", "pred", ("w", "band")).select("w", "band", "fixes", "breaks", "changed")


@query("b11_sparse_agreement", f"SELECT id, CASE WHEN {BAND.format(n=2)} AND p1 = 0 AND p2 + p3 = 2 THEN 1 WHEN {BAND.format(n=2)} AND p1 = 1 AND p2 + p3 = 0 THEN -1 ELSE 0 END AS vote FROM preds")
def sparse_agreement(b: Base) -> DataFrame:
    rows = ranking.top_half(fusion.votes(b.scored(), ["s2", "s3"]), "s1")
    inside = ranking.in_band(2)
    return rows.select("id", F.when(inside & (F.col("pred") == 0) & (F.col("votes") == 2), 1).when(inside & (F.col("pred") == 1) & (F.col("votes") == 0), -1).otherwise(0).alias("vote"))


SWAPS = f""", dis AS (SELECT * FROM preds WHERE {BAND.format(n=3)} AND p1 <> p2), sw AS (SELECT a.u, a.id AS up_id, b.id AS down_id, a.s2 - b.s2 AS gain
  FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY r1) AS m FROM dis WHERE p1 = 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY u ORDER BY r1 DESC) AS m FROM dis WHERE p1 = 1) b USING (u, m))"""


@query("b12_pairwise_swaps", SWAPS + " SELECT u, up_id, down_id FROM sw")
def pairwise_swaps(b: Base) -> DataFrame:
    return fusion.band_swaps(b.scored(), "s1", "s2", 3)


@query("k07_budgeted_swaps", SWAPS + " SELECT u, up_id, down_id, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(gain, 6) DESC, up_id, down_id) AS q FROM sw) WHERE q = 1 ORDER BY round(gain, 6) DESC, u LIMIT 100")
def budgeted_swaps(b: Base) -> DataFrame:
    rows = b.scored()
    swaps = fusion.band_swaps(rows, "s1", "s2", 3)
    score = {x: rows.select(F.col("id").alias(f"{x}_id"), F.col("s2").alias(x)) for x in ("up", "down")}
    gained = swaps.join(score["up"], "up_id").join(score["down"], "down_id").withColumn("gain", r6(F.col("up") - F.col("down")))
    return fusion.budgeted(gained, "gain", 100).select("u", "up_id", "down_id", "gain")


PAIR = ", edge AS (SELECT a.u, a.id AS top_id, b.id AS next_id, a.label AS top_label, b.label AS next_label, a.s1 - b.s1 AS margin, a.s2 AS top2, b.s2 AS next2, a.s3 AS top3, b.s3 AS next3 FROM preds a JOIN preds b ON a.u = b.u AND a.r1 = a.k AND b.r1 = b.k + 1)"


def edges(b: Base) -> DataFrame:
    """The rows on either side of each user's boundary, side by side."""
    rows = ranking.top_half(b.scored(), "s1")
    top = rows.where("rank_in_user = k_in_user").select("u", *[F.col(c).alias(f"top_{c}") for c in ("id", "label", *S)])
    after = rows.where("rank_in_user = k_in_user + 1").select("u", *[F.col(c).alias(f"next_{c}") for c in ("id", "label", *S)])
    return top.join(after, "u").withColumn("margin", F.col("top_s1") - F.col("next_s1"))


@query("b13_near_tie_swap", PAIR + " SELECT u, top_id, next_id FROM edge WHERE round(margin, 9) < 0.1 AND next2 > top2 AND next3 > top3")
def near_tie_swap(b: Base) -> DataFrame:
    return edges(b).where((F.round("margin", 9) < 0.1) & (F.col("next_s2") > F.col("top_s2")) & (F.col("next_s3") > F.col("top_s3"))).select("u", "top_id", "next_id")


@query("j11_boundary_pairs", PAIR + " SELECT u, top_id, next_id, round(margin, 6) AS margin FROM edge WHERE top_label + next_label = 1")
def boundary_pairs(b: Base) -> DataFrame:
    return edges(b).where("top_label + next_label = 1").select("u", "top_id", "next_id", r6(F.col("margin")).alias("margin"))


MASK = ", us AS (SELECT u, max(deg) AS deg, avg(pop) AS mean_pop FROM base GROUP BY u), q AS (SELECT quantile_cont(deg, 0.25) AS lo, quantile_cont(mean_pop, 0.75) AS hi FROM us)"


@query("b15_user_masks", MASK + " SELECT u, CAST(deg <= lo AS INT) AS short, CAST(mean_pop >= hi AS INT) AS popular, CAST(deg <= lo OR mean_pop >= hi AS INT) AS either, CAST(deg <= lo AND mean_pop >= hi AS INT) AS \"both\" FROM us CROSS JOIN q")
def user_masks(b: Base) -> DataFrame:
    users = b.scored().groupBy("u").agg(F.max("deg").alias("deg"), F.avg("pop").alias("mean_pop"))
    q = stats.quantiles(users, {"lo": ("deg", 0.25), "hi": ("mean_pop", 0.75)})
    low, high = F.col("deg") <= F.col("lo"), F.col("mean_pop") >= F.col("hi")
    return users.crossJoin(F.broadcast(q)).select("u", low.cast("int").alias("short"), high.cast("int").alias("popular"), (low | high).cast("int").alias("either"), (low & high).cast("int").alias("both"))


@query("b16_pop_correction", ZS + " SELECT a AS alpha, CAST(sum(CAST(pn = label AS INT)) AS BIGINT) AS right_rows FROM (SELECT a, label, CAST(row_number() OVER (PARTITION BY a, u ORDER BY round(z2 - a * z1, 9) DESC, id) <= k AS INT) AS pn FROM zs CROSS JOIN (SELECT unnest([0.0, 0.2, 0.5])::DOUBLE AS a)) GROUP BY 1")
def pop_correction(b: Base) -> DataFrame:
    rows = fusion.with_z(b.scored(), ["s1", "s2"]).select("*", F.explode(F.array(*map(F.lit, (0.0, 0.2, 0.5)))).alias("alpha"))
    rows = ranking.top_half(rows.withColumn("c", F.round(F.col("z_s2") - F.col("alpha") * F.col("z_s1"), 9)), "c", keys=("alpha", "u"))
    return rows.groupBy("alpha").agg(F.sum((F.col("pred") == F.col("label")).cast("int")).alias("right_rows"))


@query("b17_negative_reweight", ", ng AS (SELECT *, (s1 - avg(s1) OVER ()) / stddev_pop(s1) OVER () AS zz FROM preds WHERE label = 0) SELECT beta, round(sum(exp(beta * zz) * CAST(p1 = 0 AS INT)) / sum(exp(beta * zz)), 6) AS \"right\" FROM ng CROSS JOIN (SELECT unnest(range(-80, 81)) / 20 AS beta) GROUP BY beta")
def negative_reweight(b: Base) -> DataFrame:
    return rounded(fusion.negative_weights(ranking.top_half(b.scored(), "s1"), "s1", [n / 20 for n in range(-80, 81)]))


FB = "count_if(p1 <> label AND p2 = label) AS fixes, count_if(p1 = label AND p2 <> label) AS breaks"


def two(b: Base) -> DataFrame:
    return ranking.top_half(ranking.top_half(b.scored(), "s2", pred="p2").drop("rank_in_user", "k_in_user"), "s1", pred="p1")


@query("e03_fix_break", f"SELECT fixes, breaks, changed, n_rows, round((fixes - breaks) / n_rows, 6) AS delta FROM (SELECT {FB}, count_if(p1 <> p2) AS changed, count(*) AS n_rows FROM preds)")
def fix_break(b: Base) -> DataFrame:
    return rounded(evaluation.fix_break(two(b), "p1", "p2"))


@query("e05_mcnemar_stat", f"SELECT round(pow(greatest(abs(fixes - breaks) - 1, 0), 2) / (fixes + breaks), 6) AS stat FROM (SELECT {FB} FROM preds)")
def mcnemar_stat(b: Base) -> DataFrame:
    return evaluation.fix_break(two(b), "p1", "p2").select(r6(evaluation.mcnemar(F.col("fixes"), F.col("breaks"))).alias("stat"))


@query("e07_flip_precision", "SELECT r1 - k AS place, count(*) AS flips, round(avg(CAST(p2 = label AS INT)), 6) AS precision FROM preds WHERE p1 <> p2 GROUP BY 1")
def flip_precision(b: Base) -> DataFrame:
    rows = two(b).where("p1 <> p2")
    return rows.groupBy((F.col("rank_in_user") - F.col("k_in_user")).alias("place")).agg(F.count(F.lit(1)).alias("flips"), r6(F.avg((F.col("p2") == F.col("label")).cast("int"))).alias("precision"))


@query("e08_decorrelation", ZS + " SELECT round(corr(z1, z2), 6) AS c12, round(corr(z1, z3), 6) AS c13, round(corr(z2, z3), 6) AS c23 FROM zs")
def decorrelation(b: Base) -> DataFrame:
    rows = fusion.with_z(b.scored(), S)
    return rows.agg(*[r6(F.corr(f"z_s{x}", f"z_s{y}")).alias(f"c{x}{y}") for x, y in ((1, 2), (1, 3), (2, 3))])


@query("e09_boundary_auc", PAIR + ", x AS (SELECT top_label AS y, rank() OVER (ORDER BY round(top2 - next2, 9)) AS r, count(*) OVER (PARTITION BY round(top2 - next2, 9)) AS c FROM edge WHERE top_label + next_label = 1) SELECT round((sum((r + (c - 1) / 2) * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM x")
def boundary_auc(b: Base) -> DataFrame:
    rows = edges(b).where("top_label + next_label = 1").select(F.col("top_label").alias("label"), F.round(F.col("top_s2") - F.col("next_s2"), 9).alias("x"))
    return rounded(stats.auc(rows, "x"))


@query("e11_band_oracle", f"SELECT n AS width, count_if(r1 > k - n AND r1 <= k + n AND p1 <> label) AS wrong_inside, count_if(NOT (r1 > k - n AND r1 <= k + n) AND p1 <> label) AS wrong_outside FROM preds CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) GROUP BY n")
def band_oracle(b: Base) -> DataFrame:
    rows = ranking.top_half(b.scored(), "s1").where("pred <> label").select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("width"))
    inside = (F.col("rank_in_user") > F.col("k_in_user") - F.col("width")) & (F.col("rank_in_user") <= F.col("k_in_user") + F.col("width"))
    return rows.groupBy("width").agg(F.count_if(inside).alias("wrong_inside"), F.count_if(~inside).alias("wrong_outside"))


@query("e12_gate", GRID + ", f AS (SELECT w, band, count_if(p1 <> label AND pn::INT = label) AS fixes, count_if(p1 = label AND pn::INT <> label) AS breaks FROM g GROUP BY 1, 2) SELECT w, band, CASE WHEN fixes > breaks AND fixes >= 20 AND fixes / (fixes + breaks) >= 0.52 THEN 'promote' WHEN fixes >= breaks THEN 'hold' ELSE 'reject' END AS verdict FROM f")
def gate(b: Base) -> DataFrame:
    rows = fusion.residual_grid(b.scored(), "s1", "s2", [0.1, 0.3, 0.5], [1, 2])
    counts = evaluation.fix_break(ranking.top_half(rows, "fused", keys=("w", "band", "u")), "base_pred", "pred", ("w", "band"))
    return evaluation.gate(counts, 20, 0.52).select("w", "band", "verdict")


@query("e14_preflight", "SELECT count(*) AS n_rows, count_if(p1 IS NULL) AS missing, count_if(p1 NOT IN (0, 1)) AS not_binary, CAST(sum(p1) AS BIGINT) AS positives, (SELECT count(*) FROM (SELECT u FROM preds GROUP BY u HAVING sum(p1) <> count(*) // 2)) AS uneven_users, count(DISTINCT id) AS ids FROM preds")
def preflight(b: Base) -> DataFrame:
    out = evaluation.preflight(ranking.top_half(b.scored(), "s1"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("e15_integrity", " UNION ALL ".join(("" if n == 1 else "") + f"SELECT 's{n}' AS axis, count(*) AS n_rows, count_if(s{n} IS NULL OR isnan(s{n})) AS bad, count(DISTINCT s{n}) AS \"values\", CAST(count(DISTINCT s{n}) < 100 AS INT) AS thin FROM base" for n in (1, 2, 3)))
def integrity(b: Base) -> DataFrame:
    return evaluation.integrity(b.scored(), S)


@query("u01_union_all", "SELECT u, i, 0 AS held FROM train UNION ALL SELECT u, i, 1 FROM held")
def union_all(b: Base) -> DataFrame:
    """Both halves of the split under each other."""
    return b.train().select("u", "i", F.lit(0).alias("held")).unionByName(b.held().select("u", "i", F.lit(1).alias("held")))


@query("u02_dedupe_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1", frames=False)
def dedupe_first(b: Base) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return b.table("orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


def changed(b: Base) -> DataFrame:
    """name, id of the rows that each score decodes differently from s1."""
    rows = fusion.votes(b.scored(), S).withColumn("c", ranking.position("s1"))
    rows = rows.withColumn("mean", sum(F.col(f"pred_{s}") for s in S))
    pairs = {"s2": F.col("pred_s2"), "s3": F.col("pred_s3"), "vote": (F.col("mean") >= 2).cast("int")}
    return rows.select("id", "pred_s1", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.alias("p")) for k, p in pairs.items()])).alias("x")).where("x.p <> pred_s1").select("x.name", "id")


CHANGED = ", ch AS (SELECT 's2' AS name, id FROM preds WHERE p2 <> p1 UNION ALL SELECT 's3', id FROM preds WHERE p3 <> p1 UNION ALL SELECT 'vote', id FROM preds WHERE CAST(p1 + p2 + p3 >= 2 AS INT) <> p1)"


@query("u03_changed_union", CHANGED + " SELECT DISTINCT id FROM ch")
def changed_union(b: Base) -> DataFrame:
    return changed(b).select("id").distinct()


@query("u04_jaccard_matrix", CHANGED + """, n AS (SELECT name, count(*) AS n FROM ch GROUP BY name), j AS (SELECT a.name AS a, b.name AS b, count(*) AS common FROM ch a JOIN ch b USING (id) WHERE a.name < b.name GROUP BY 1, 2)
  SELECT x.name AS a, y.name AS b, coalesce(common, 0) AS common, round(coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)), 6) AS jaccard FROM n x JOIN n y ON x.name < y.name LEFT JOIN j ON j.a = x.name AND j.b = y.name""")
def jaccard_matrix(b: Base) -> DataFrame:
    return rounded(evaluation.overlaps(changed(b)))


@query("u05_symmetric_difference", "SELECT u, CAST(sum(CAST(p1 <> p2 AS INT)) AS BIGINT) AS n FROM preds GROUP BY u")
def symmetric_difference(b: Base) -> DataFrame:
    return two(b).groupBy("u").agg(F.sum((F.col("p1") != F.col("p2")).cast("int")).alias("n"))


@query("u06_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders", frames=False)
def except_users(b: Base) -> DataFrame:
    return b.table("customer").select("c_custkey").join(b.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@query("u07_row_diff", "SELECT count(*) AS n_rows, count_if(p1 <> p2) AS differing, count(DISTINCT CASE WHEN p1 <> p2 THEN u END) AS users FROM preds")
def row_diff(b: Base) -> DataFrame:
    return two(b).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p1") != F.col("p2")).alias("differing"), F.count_distinct(F.when(F.col("p1") != F.col("p2"), F.col("u"))).alias("users"))


@query("o01_near_duplicate_guard", CHANGED + ", t AS (SELECT count(*) AS n FROM preds) SELECT name, count(*) AS rows_changed, CASE WHEN count(*) < 0.05 * any_value(t.n) THEN 'near duplicate' ELSE 'distinct' END AS verdict FROM ch CROSS JOIN t GROUP BY name")
def near_duplicate_guard(b: Base) -> DataFrame:
    total = b.candidates().agg(F.count(F.lit(1)).alias("n"))
    counts = changed(b).groupBy("name").agg(F.count(F.lit(1)).alias("rows_changed"))
    return counts.crossJoin(F.broadcast(total)).select("name", "rows_changed", F.when(F.col("rows_changed") < 0.05 * F.col("n"), "near duplicate").otherwise("distinct").alias("verdict"))


@query("o01_choose_variants")
def choose_variants(b: Base) -> DataFrame:
    """step, name, n_changed, gain: up to six variants of a re-ranking by the rows near users' boundaries that each adds."""
    rows = fusion.residual_grid(b.scored(), "s1", "s2", [0.1, 0.3, 0.5, 1.0], [1, 2, 3])
    rows = ranking.top_half(rows, "fused", keys=("w", "band", "u")).where("pred <> base_pred")
    near = F.round(1 / (1 + F.abs(F.col("base_rank") - F.col("k_in_user") - 0.5)), 6)
    return variants.choose(rows.select(F.concat_ws("/", "w", "band").alias("name"), "id", near.alias("worth")), 6, 20, F.col("worth"))


@query("o02_best_and_quota", "SELECT CAST(ts AS DATE) AS day, count(*) AS used, greatest(0, 50 - count(*)) AS left_over, max(value) AS best, arg_max(event_id, (value, -event_id)) AS best_id FROM events GROUP BY 1", frames=False)
def best_and_quota(b: Base) -> DataFrame:
    rows = b.table("events").groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("used"), F.greatest(F.lit(0), 50 - F.count(F.lit(1))).alias("left_over"), F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_id"))


@query("o03_row_digest", "SELECT u, sha256(string_agg(id || ':' || p1, ',' ORDER BY id)) AS digest FROM preds GROUP BY u")
def row_digest(b: Base) -> DataFrame:
    cell = F.concat(F.col("id").cast("string"), F.lit(":"), F.col("pred").cast("string")).alias("c")
    rows = ranking.top_half(b.scored(), "s1").select("u", "id", cell)
    return rows.groupBy("u").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda x: x["c"]), ","), 256).alias("digest"))
