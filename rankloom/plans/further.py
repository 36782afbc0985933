"""Rules, checks, resampling and samplers beside the plain operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import evaluation, fusion, ranking, resampling, similarity, split, stats
from rankloom.plans.base import Base
from rankloom.plans.registry import query
from rankloom.plans.windows import BAND, GRID, PAIR, ZS, edges
from rankloom.sources import io

r6 = lambda c: F.round(c, 6)
S = ["s1", "s2", "s3"]
UNIT = "(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) + 1) / 1152921504606846977.0::DOUBLE"


@query("p05_columns", "SELECT id, s1 AS score_pop, s3 AS score_hours FROM base")
def columns(b: Base) -> DataFrame:
    """The columns that an include and an exclude pattern leave."""
    rows = b.scored().select("id", F.col("s1").alias("score_pop"), F.col("s2").alias("score_day"), F.col("s3").alias("score_hours"), "label")
    return rows.select("id", *io.score_columns(rows, include="pop|day|hours", exclude="^score_day$"))


@query("s08_key_identity", "SELECT count(*) AS keys, CAST(0 AS BIGINT) AS incomplete, round(avg((s1 + s2 + s3) / 3), 6) AS mean FROM base")
def key_identity(b: Base) -> DataFrame:
    """How many keys of three score files stand in all of them, and in not all."""
    rows = b.scored()
    out = io.ensemble([rows.select(F.col("id").alias("ID"), F.col(s).alias("score")) for s in S], "score", strict=False)
    return out.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") != 3).alias("incomplete"), r6(F.avg("mean")).alias("mean"))


@query("s10_label_checks", "SELECT count(*) AS n_rows, count(DISTINCT id) AS ids, min(id) AS lo, max(id) AS hi, count_if(p1 NOT IN (0, 1)) AS not_binary, CAST(count(DISTINCT id) = count(*) AND max(id) - min(id) + 1 = count(*) AS INT) AS contiguous FROM preds")
def label_checks(b: Base) -> DataFrame:
    return io.label_checks(ranking.top_half(b.scored(), "s1").select(F.col("id").alias("ID"), F.col("pred").alias("Label")))


@query("w05_z_global", "SELECT id, round((s1 - avg(s1) OVER ()) / stddev_pop(s1) OVER (), 6) AS z1, round(coalesce((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 0.0), 6) AS z_finite FROM (SELECT *, CASE WHEN s2 > -10 THEN s2 END AS f FROM base)")
def z_global(b: Base) -> DataFrame:
    """Standard scores over all rows, and over the finite values alone, where the others get 0."""
    rows = b.scored().withColumn("f", F.when(F.col("s2") > -10, F.col("s2")))
    scale = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("s1", "f") for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"d_{c}"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(scale)).select("id", r6(z("s1")).alias("z1"), r6(F.coalesce(z("f"), F.lit(0.0))).alias("z_finite"))


@query("w16_gated_band", f""", sd AS (SELECT *, sqrt((pow(s1 - (s1 + s3) / 2, 2) + pow(s3 - (s1 + s3) / 2, 2)) / 2) AS sd FROM preds), q AS (SELECT quantile_cont(round(sd, 9), 0.7) AS hi, quantile_cont(p1 + p2 + p3, 0.4) AS lo FROM sd)
  SELECT id, CAST(round(sd, 9) >= hi AS INT) AS uncertain, CAST(p1 + p2 + p3 <= lo AS INT) AS unloved FROM sd CROSS JOIN q WHERE {BAND.format(n=2)} AND (round(sd, 9) >= hi OR p1 + p2 + p3 <= lo)""")
def gated_band(b: Base) -> DataFrame:
    """Rows of the boundary band whose scores spread widely or that few scores vote for, by quantiles over all rows."""
    rows = fusion.votes(b.scored(), S).withColumn("sd", F.round(fusion.deviation_of(["s1", "s3"]), 9))
    rows = ranking.top_half(rows, "s1").crossJoin(F.broadcast(stats.quantiles(rows, {"hi": ("sd", 0.7), "lo": ("votes", 0.4)})))
    flags = (F.col("sd") >= F.col("hi")), (F.col("votes") <= F.col("lo"))
    return rows.where(ranking.in_band(2) & (flags[0] | flags[1])).select("id", flags[0].cast("int").alias("uncertain"), flags[1].cast("int").alias("unloved"))


RULES = {"vote2": "(d2 > {t})::INT + (d1 > {t})::INT + (d3 > {t})::INT >= 2", "vote_other": "d3 > {t} AND d1 > -{g}", "vote_both": "d2 > {t} AND d3 > {t}", "against_anchor": "d3 > {t} AND d2 > {t} AND d1 > -{g}"}


@query("b12_promote_rules", ZS + f""", zr AS (SELECT u, id, r1, k, p1, {", ".join(f"round(z{n}, 9) AS z{n}" for n in (1, 2, 3))} FROM zs), pr AS (SELECT c.u, c.id AS cid, t.id AS tid, c.z1 - t.z1 AS d1, c.z2 - t.z2 AS d2, c.z3 - t.z3 AS d3
    FROM zr c JOIN zr t ON c.u = t.u AND c.p1 = 0 AND t.p1 = 1 AND c.r1 <= c.k + 3 AND t.r1 > t.k - 3),
  fr AS ({" UNION ALL ".join(f"SELECT '{name}' AS rule, u, cid, tid FROM pr WHERE {sql.format(t='0.1', g='0.5')}" for name, sql in RULES.items())}),
  wi AS (SELECT rule, u, cid, count(*) AS wins FROM fr GROUP BY ALL), lo AS (SELECT rule, u, tid, count(*) AS losses FROM fr GROUP BY ALL),
  up AS (SELECT rule, wi.u, cid AS id, row_number() OVER (PARTITION BY rule, wi.u ORDER BY wins DESC, round(z3 + z2, 8) DESC, z1 DESC, cid) AS m FROM wi JOIN zr ON id = cid),
  n AS (SELECT rule, up.u, least(count(*), 2, any_value(tops)) AS n FROM up JOIN (SELECT u, count(*) AS tops FROM zr WHERE p1 = 1 AND r1 > k - 3 GROUP BY u) t ON t.u = up.u GROUP BY ALL),
  dn AS (SELECT n.rule, n.u, zr.id, row_number() OVER (PARTITION BY n.rule, n.u ORDER BY coalesce(losses, 0) DESC, round(z3 + z2, 8), z1, zr.id DESC) AS m, n FROM n JOIN zr ON zr.u = n.u AND p1 = 1 AND r1 > k - 3 LEFT JOIN lo ON lo.rule = n.rule AND lo.tid = zr.id)
  SELECT rule, u, id, 1 AS pred FROM up JOIN n USING (rule, u) WHERE m <= n UNION ALL SELECT rule, u, id, 0 FROM dn WHERE m <= n""")
def promote_rules(b: Base) -> DataFrame:
    """rule, u, id, pred: the rows that four rules lift above the boundary and those that make room for them."""
    return fusion.promoted(b.scored(), "s1", "s2", "s3", band=3, tau=0.1, guard=0.5, most=2)


TRIPLETS = f""", dr AS (SELECT u, i AS pos, j, CAST('0x' || substr(md5('bpr:' || u || ':' || i || ':' || j), 1, 15) AS BIGINT) % size AS place FROM train CROSS JOIN (SELECT unnest(range(0, 60)) AS j) CROSS JOIN (SELECT count(*) AS size FROM part)),
  tr AS (SELECT u, pos, arg_min(neg, j) AS neg FROM dr JOIN (SELECT p_partkey AS neg, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) USING (place) WHERE (u, neg) NOT IN (SELECT (u, i) FROM inter) GROUP BY 1, 2)"""


@query("n09_bpr_triplets", TRIPLETS + " SELECT u, pos, neg FROM tr")
def bpr_triplets(b: Base) -> DataFrame:
    """u, pos, neg: for each training pair an item that the user hasn't seen."""
    return split.triplets(b.train(), b.items(), b.stored(), "bpr:")


@query("n13_weighted_pairs", TRIPLETS + """, pc AS (SELECT u, i AS pos, 0.5 + 0.5 * (rank() OVER (PARTITION BY u ORDER BY hours) + (count(*) OVER (PARTITION BY u, hours) - 1) / 2) / count(*) OVER (PARTITION BY u) AS w FROM train)
  SELECT u, pos AS i, 1 AS label, round(w, 6) AS w FROM pc UNION ALL SELECT u, neg, 0, round(w, 6) FROM pc JOIN tr USING (u, pos)""")
def weighted_pairs(b: Base) -> DataFrame:
    """u, i, label, w: training pairs and an unseen item for each, both with the confidence from the rank of the hours."""
    share = ranking.average_rank("hours") / F.count(F.lit(1)).over(ranking.by_user())
    train = b.train()
    rows = train.select("u", F.col("i").alias("pos"), r6(0.5 + 0.5 * share).alias("w"))
    drawn = rows.join(split.triplets(train, b.items(), b.stored(), "bpr:"), ["u", "pos"])
    return rows.select("u", F.col("pos").alias("i"), F.lit(1).alias("label"), "w").unionByName(drawn.select("u", F.col("neg").alias("i"), F.lit(0).alias("label"), "w"))


CUTS = ", ".join(f"{p!r}::DOUBLE" for p in resampling.POISSON)
WEIGHT = "len(list_filter([{cuts}], lambda p: {x} > p))"
BOOT = f""", us AS (SELECT u, sum((p1 = label)::INT) AS a, sum((p2 = label)::INT) AS b, count(*) AS n FROM preds GROUP BY u), bt AS (SELECT round, CAST(sum(w * a) AS DOUBLE) / sum(w * n) AS acc, CAST(sum(w * (b - a)) AS DOUBLE) / sum(w * n) AS delta
  FROM (SELECT *, {WEIGHT.format(cuts=CUTS, x=UNIT.format(key="'boot:' || u || ':' || round"))} AS w FROM us CROSS JOIN (SELECT unnest(range(1, 201)) AS round)) GROUP BY round)"""


@query("n12_user_interval", BOOT + " SELECT round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM bt")
def user_interval(b: Base) -> DataFrame:
    out = resampling.user_bootstrap(ranking.top_half(b.scored(), "s1"), 200)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("n12_paired_interval", BOOT + " SELECT round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS error, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM bt")
def paired_interval(b: Base) -> DataFrame:
    rows = ranking.top_half(ranking.top_half(b.scored(), "s2", pred="other").drop("rank_in_user", "k_in_user"), "s1")
    out = resampling.paired_bootstrap(rows, "pred", "other", 200)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("n12_auc_interval", f""", wt AS (SELECT round, s1, label, {WEIGHT.format(cuts=CUTS, x=UNIT.format(key="'auc:' || id || ':' || round"))} AS w FROM base CROSS JOIN (SELECT unnest(range(1, 41)) AS round)),
  hs AS (SELECT round, s1, sum(w * label) AS p, sum(w * (1 - label)) AS m FROM wt GROUP BY 1, 2), au AS (SELECT round, sum(p * (below + m / 2)) / (sum(p) * sum(m)) AS auc FROM (SELECT *, coalesce(sum(m) OVER (PARTITION BY round ORDER BY s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hs) GROUP BY round)
  SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM au""")
def auc_interval(b: Base) -> DataFrame:
    out = resampling.auc_bootstrap(b.scored().select("id", F.col("s1").alias("score"), "label"), 40)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("a22_ceilings", "SELECT count(*) AS n_rows, round(avg((p1 = label OR p2 = label OR p3 = label)::INT), 6) AS oracle, round(avg(((p1 + p2 + p3 >= 2)::INT = label)::INT), 6) AS majority, count_if(p1 = label AND p2 = label) AS both_right, count_if(p1 = label AND p2 <> label) AS first_only, count_if(p1 <> label AND p2 = label) AS second_only, count_if(p1 <> label AND p2 <> label) AS both_wrong FROM preds")
def ceilings(b: Base) -> DataFrame:
    """What the best choice among three models and their majority reach, and the 2 x 2 table of the first two."""
    rows = fusion.votes(b.scored(), S)
    right = [F.col(f"pred_{s}") == F.col("label") for s in S]
    share = lambda c: r6(F.avg(c.cast("int")))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), share(right[0] | right[1] | right[2]).alias("oracle"), share((F.col("votes") >= 2).cast("int") == F.col("label")).alias("majority"), *[F.count_if(x & y).alias(n) for n, x, y in (("both_right", right[0], right[1]), ("first_only", right[0], ~right[1]), ("second_only", ~right[0], right[1]), ("both_wrong", ~right[0], ~right[1]))])


@query("e12_tiers", GRID + """, f AS (SELECT w, band, count_if(p1 <> label AND pn::INT = label) AS fixes, count_if(p1 = label AND pn::INT <> label) AS breaks, avg((pn::INT = label)::INT) AS acc, corr(pn::INT, p1) AS c FROM g GROUP BY 1, 2)
  SELECT w, band, CASE WHEN acc < 0.5 THEN 'below floor' WHEN abs(c) > 0.995 THEN 'too alike' WHEN abs(fixes - breaks) <= 2 * sqrt(fixes + breaks) THEN 'noise' WHEN fixes > breaks THEN 'strict' ELSE 'worse' END AS tier FROM f""")
def tiers(b: Base) -> DataFrame:
    """A variant's tier: under the floor of accuracy, too alike to the base, within the noise of its changes, or apart."""
    rows = fusion.residual_grid(b.scored(), "s1", "s2", [0.1, 0.3, 0.5], [1, 2])
    rows = ranking.top_half(rows, "fused", keys=("w", "band", "u"))
    more = rows.groupBy("w", "band").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"), F.corr("pred", "base_pred").alias("c"))
    return evaluation.tiers(evaluation.fix_break(rows, "base_pred", "pred", ("w", "band")).join(more, ["w", "band"]), floor=0.5, alike=0.995).select("w", "band", "tier")


@query("e09_residual_auc", PAIR + """, dd AS (SELECT top_label AS y, margin AS x, top3 - next3 AS f FROM edge WHERE top_label + next_label = 1), rs AS (SELECT y, round(f - regr_slope(f, x) OVER () * x - regr_intercept(f, x) OVER (), 9) AS r FROM dd),
  rk AS (SELECT y, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS r FROM rs) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 4) AS auc FROM rk""")
def residual_auc(b: Base) -> DataFrame:
    """The AUC of a feature's gap across the boundary after its part in the score's margin is taken away."""
    rows = edges(b).where("top_label + next_label = 1").select(F.col("top_label").alias("label"), F.col("margin").alias("x"), (F.col("top_s3") - F.col("next_s3")).alias("f"))
    rest = stats.residual(rows, "f", "x").withColumn("residual", F.round("residual", 9))
    return stats.auc(rest, "residual").select(F.round("auc", 4).alias("auc"))


@query("m33_two_controls", """, cv AS (SELECT covar_pop(s1, s1) AS aa, covar_pop(deg, deg) AS bb, covar_pop(s1, deg) AS ab, covar_pop(s3, s1) AS ya, covar_pop(s3, deg) AS yb, avg(s1) AS ma, avg(deg) AS mb, avg(s3) AS my FROM base)
  SELECT id, round(s3 - my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * (s1 - ma) - (yb * aa - ya * ab) / (aa * bb - ab * ab) * (deg - mb), 6) AS residual FROM base CROSS JOIN cv""")
def two_controls(b: Base) -> DataFrame:
    return stats.residual_of_two(b.scored(), "s3", "s1", "deg").select("id", r6(F.col("residual")).alias("residual"))


@query("o03_expected_digest", "SELECT u, sha256(string_agg(id || ':' || p1, ',' ORDER BY id)) = sha256(string_agg(id || ':' || p2, ',' ORDER BY id)) AS as_expected FROM preds GROUP BY u")
def expected_digest(b: Base) -> DataFrame:
    """Whether a user's decoded labels have the digest that is expected of them, here that of the second score."""
    rows = ranking.top_half(ranking.top_half(b.scored(), "s2", pred="other").drop("rank_in_user", "k_in_user"), "s1")
    cell = lambda c: F.concat(F.col("id").cast("string"), F.lit(":"), F.col(c).cast("string"))
    digest = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", cell(c).alias("c")))), lambda x: x["c"]), ","), 256)
    return rows.groupBy("u").agg((digest("pred") == digest("other")).alias("as_expected"))


@query("o01_quarantine", """, n AS (SELECT 's' || n AS name, n FROM (SELECT unnest([1, 2, 3]) AS n)), lb AS (SELECT 's1' AS name, id, p1 AS p, label FROM preds UNION ALL SELECT 's2', id, p2, label FROM preds UNION ALL SELECT 's3', id, p3, label FROM preds),
  ac AS (SELECT name, avg((p = label)::INT) AS acc FROM lb GROUP BY name), df AS (SELECT a.name AS a, b.name AS b, avg((a.p <> b.p)::INT) AS d FROM lb a JOIN lb b USING (id) WHERE a.name <> b.name GROUP BY 1, 2)
  SELECT x.name, round(x.acc, 6) AS acc, CAST(count_if(df.d < 0.3 AND (y.acc > x.acc OR y.acc = x.acc AND y.name < x.name)) AS BIGINT) AS better_kin, CASE WHEN count_if(df.d < 0.3 AND (y.acc > x.acc OR y.acc = x.acc AND y.name < x.name)) > 0 THEN 'quarantined' ELSE 'kept' END AS verdict
  FROM ac x LEFT JOIN df ON df.a = x.name LEFT JOIN ac y ON y.name = df.b GROUP BY 1, x.acc""")
def quarantine(b: Base) -> DataFrame:
    """Each score's accuracy, how many scores that decode alike are better, and whether it stands back for them."""
    rows = fusion.votes(b.scored(), S)
    differ = rows.agg(*[F.avg((F.col(f"pred_{x}") != F.col(f"pred_{y}")).cast("int")).alias(f"{x}_{y}") for x in S for y in S if x < y], *[F.avg((F.col(f"pred_{s}") == F.col("label")).cast("int")).alias(f"acc_{s}") for s in S])
    kin = lambda x: sum(((F.col("_".join(sorted((x, y)))) < 0.3) & ((F.col(f"acc_{y}") > F.col(f"acc_{x}")) | (F.col(f"acc_{y}") == F.col(f"acc_{x}")) & F.lit(y < x))).cast("long") for y in S if y != x)
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), r6(F.col(f"acc_{s}")).alias("acc"), kin(s).alias("better_kin")) for s in S])).alias("x")
    return differ.select(one).select("x.*", F.when(F.col("x.better_kin") > 0, "quarantined").otherwise("kept").alias("verdict"))


@query("m14_second_order", """, nm AS (SELECT t.u, t.i, 1.0::DOUBLE / sqrt(deg * pop) AS w FROM train t JOIN udeg USING (u) JOIN ipop USING (i)), gm AS (SELECT a.i AS i, b.i AS j, sum(a.w * b.w) AS s FROM nm a JOIN nm b ON a.u = b.u GROUP BY 1, 2),
  h AS (SELECT n.u, g.i, sum(n.w * g.s) AS y FROM nm n JOIN gm g ON g.j = n.i GROUP BY 1, 2) SELECT c.id, round(0.3 * coalesce(any_value(o.y), 0) + 0.7 * sum(h.y * coalesce(g.s, 0)), 8) AS s FROM cand c JOIN h ON h.u = c.u LEFT JOIN gm g ON g.i = c.i AND g.j = h.i LEFT JOIN h o ON o.u = c.u AND o.i = c.i GROUP BY c.id""")
def second_order(b: Base) -> DataFrame:
    """The polynomial filter P (0.3 I + 0.7 P) of the normalised matrix at candidates."""
    train, cand = b.split()
    return similarity.second_order_filter(cand, train, 0.3).select("id", F.round("s", 8).alias("s"))


@query("s03_row_idx", "SELECT id, u, i, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM cand")
def row_idx(b: Base) -> DataFrame:
    return io.numbered(b.candidates().select("id", "u", "i"), "id")


@query("s07_projection", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'", frames=False)
def projection(b: Base) -> DataFrame:
    """Three columns under two filters, which reach the scan."""
    return b.table("lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("n11_stratified_folds", "SELECT u, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('strata:' || u), u) - 1) % 5 AS INT) AS fold FROM (SELECT u, CASE WHEN count(*) <= 20 THEN 'to20' WHEN count(*) <= 40 THEN 'to40' ELSE 'over' END AS stratum FROM inter GROUP BY u)")
def stratified_folds(b: Base) -> DataFrame:
    n = F.count(F.lit(1))
    users = b.interactions().groupBy("u").agg(F.when(n <= 20, "to20").when(n <= 40, "to40").otherwise("over").alias("stratum"))
    return split.stratified_folds(users, "stratum", 5)


@query("n11_leave_one_out", "SELECT a.fold AS held, count_if(b.fold = a.fold) AS tested, count_if(b.fold <> a.fold) AS trained FROM (SELECT unnest(range(0, 5)) AS fold) a CROSS JOIN (SELECT CAST('0x' || substr(md5('fold:' || u), 1, 15) AS BIGINT) % 5 AS fold FROM (SELECT DISTINCT u FROM inter)) b GROUP BY 1")
def leave_one_out(b: Base) -> DataFrame:
    """For each fold, how many users are tested on it and trained without it."""
    sizes = split.folds(b.interactions().select("u").distinct(), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.crossJoin(F.broadcast(sizes.select(F.col("fold").cast("long").alias("held"))))
    inside = F.col("fold") == F.col("held")
    return rows.groupBy("held").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("tested"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("trained"))


@query("j14_overlap_pairs", ", c AS (SELECT i, count(*) AS n FROM train GROUP BY i), p AS (SELECT a.i AS i, b.i AS j, count(*) AS s FROM train a JOIN train b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2) SELECT p.i, p.j, round(s / (a.n + b.n - s), 6) AS jaccard FROM p JOIN c a ON a.i = p.i JOIN c b ON b.i = p.j")
def overlap_pairs(b: Base) -> DataFrame:
    """The Jaccard similarity of items' holders, for all items that share one."""
    train = b.train()
    return similarity.counted_pairs(train).select("i", "j", r6(F.col("s") / (F.col("pi") + F.col("pj") - F.col("s"))).alias("jaccard"))
