"""Scoring queries: similarities, neighbourhoods, filters, texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import vectors as V
from rankloom.operators import evaluation, fusion, graph, ranking, stats
from rankloom.operators import similarity as sim
from rankloom.plans.base import Base
from rankloom.plans.registry import query

r6 = lambda c: F.round(c, 6)

CO = ", co AS (SELECT a.i AS i, b.i AS j, count(*) AS s FROM train a JOIN train b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2)"
COS = CO + """, pn AS (SELECT i, sqrt(count(*)) AS norm FROM train GROUP BY i), half AS (SELECT co.i, co.j, s / greatest(a.norm * b.norm, 1e-12) AS sim FROM co JOIN pn a ON a.i = co.i JOIN pn b ON b.i = co.j),
  sims AS (SELECT i, j, sim FROM half UNION ALL SELECT j, i, sim FROM half)"""
HIST = ", hs AS (SELECT c.id, coalesce(s.sim, 0.0) AS sim, t.hours FROM cand c JOIN train t ON t.u = c.u LEFT JOIN sims s ON s.i = c.i AND s.j = t.i)"


@query("m01_matrix", "SELECT u, i, 1 AS seen, round(hours_t, 6) AS value FROM train")
def matrix(b: Base) -> DataFrame:
    return b.train().select("u", "i", F.lit(1).alias("seen"), r6(F.col("hours_t")).alias("value"))


@query("j07_cooccurrence", CO + " SELECT i, j, s FROM co")
def cooccurrence(b: Base) -> DataFrame:
    return sim.co_occurrence(b.train())


ORD = """, o AS (SELECT u, i, d, row_number() OVER (PARTITION BY u ORDER BY d, i) AS p FROM train), op AS (SELECT a.i AS i, b.i AS j, sum(pow(0.75, b.p - a.p - 1) * pow(0.5, date_diff('day', a.d, b.d) / 730.0)) AS w
  FROM o a JOIN o b ON a.u = b.u AND b.p > a.p AND b.p <= a.p + 20 GROUP BY 1, 2)"""


@query("j09_ordered_band_join", ORD + " SELECT i, j, round(w, 6) AS w FROM op")
def ordered_band_join(b: Base) -> DataFrame:
    return sim.ordered_pairs(b.train()).withColumn("w", r6(F.col("w")))


ORD9 = ORD + """, hh AS (SELECT u, i, ln(1 + hours_t) AS h, row_number() OVER (PARTITION BY u ORDER BY d DESC, i DESC) - 1 AS age FROM train),
  bt AS (SELECT a.i AS i, b.i AS j, count(*) AS co, sum(a.h + b.h) AS hours FROM hh a JOIN hh b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2),
  mt AS (SELECT c.id, x.age, coalesce(bt.co, 0) / sq AS c, coalesce(bt.hours, 0) / (coalesce(bt.co, 0) + 1) AS h, coalesce(f.w, 0) / sq AS f, coalesce(r.w, 0) / sq AS r
    FROM (SELECT c.*, t.i AS j, sqrt(greatest(coalesce(p.pop, 0) * q.pop, 1)) AS sq FROM cand c JOIN train t ON t.u = c.u LEFT JOIN ipop p ON p.i = c.i JOIN ipop q ON q.i = t.i) c
    JOIN hh x ON x.u = c.u AND x.i = c.j LEFT JOIN bt ON bt.i = c.j AND bt.j = c.i LEFT JOIN op f ON f.i = c.j AND f.j = c.i LEFT JOIN op r ON r.i = c.i AND r.j = c.j),
  nine AS (SELECT id, sum(c) AS co_sum, max(c) AS co_max, list_avg(max(c, 5)) AS co_top5, sum(h) AS hours_sum, max(h) AS hours_max, sum(CASE WHEN age < 20 THEN f * pow(0.85, age) ELSE 0 END) AS forward,
    sum(CASE WHEN age < 20 THEN r * pow(0.85, age) ELSE 0 END) AS reverse, sum(CASE WHEN age < 5 THEN c * pow(0.75, age) ELSE 0 END) AS last5_co, sum(CASE WHEN age < 5 THEN f * pow(0.75, age) ELSE 0 END) AS last5_forward FROM mt GROUP BY id)"""
NINE = ("co_sum", "co_max", "co_top5", "hours_sum", "hours_max", "forward", "reverse", "last5_co", "last5_forward")


@query("m16_covisitation", ORD9 + f""", zs AS (SELECT id, u, {", ".join(f"{c}, CASE WHEN coalesce(stddev_samp({c}) OVER w, 0) > 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END AS z_{c}" for c in NINE)}
  FROM (SELECT id, u, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in NINE)} FROM cand LEFT JOIN nine USING (id)) WINDOW w AS (PARTITION BY u))
  SELECT id, {", ".join(f"round({c}, 6) AS {c}" for c in NINE)}, round(({" + ".join(f"z_{c}" for c in NINE)}) / 9, 5) AS mean_z FROM zs""")
def covisitation(b: Base) -> DataFrame:
    """The nine scores of a candidate and the mean of their standard scores within the user."""
    train, cand = b.split()
    rows = cand.select("id", "u").join(sim.covisitation(cand, train), "id", "left").na.fill(0.0, list(NINE))
    mean = sum(ranking.z(c) for c in NINE) / len(NINE)
    return rows.select("id", *[r6(F.col(c)).alias(c) for c in NINE], F.round(mean, 5).alias("mean_z"))


@query("j10_unseen_pool_counts", "SELECT u, (SELECT count(*) FROM part) - count(*) AS unseen FROM inter GROUP BY u")
def unseen_pool_counts(b: Base) -> DataFrame:
    """How many items each user hasn't seen, by counts: the pool itself is never built."""
    items = b.table("part").agg(F.count(F.lit(1)).alias("items"))
    return b.interactions().groupBy("u").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(items)).select("u", (F.col("items") - F.col("n")).alias("unseen"))


@query("j12_band_theta_join", "SELECT a.u, a.id AS top_id, b.id AS low_id FROM preds a JOIN preds b ON a.u = b.u AND a.r1 <= a.k AND a.r1 > a.k - 2 AND b.r1 > b.k AND b.r1 <= b.k + 2 AND b.s2 > a.s2 AND b.s3 > a.s3")
def band_theta_join(b: Base) -> DataFrame:
    rows = ranking.top_half(b.scored(), "s1").where(ranking.in_band(2))
    top = rows.where("pred = 1").select("u", F.col("id").alias("top_id"), F.col("s2").alias("a2"), F.col("s3").alias("a3"))
    low = rows.where("pred = 0").select("u", F.col("id").alias("low_id"), F.col("s2").alias("b2"), F.col("s3").alias("b3"))
    return top.join(low, "u").where("b2 > a2 and b3 > a3").select("u", "top_id", "low_id")


@query("j13_pair_expansion", """, pr AS (SELECT p.u, p.id AS pid, n.id AS nid, round(p.s1 - n.s1, 6) AS g1, row_number() OVER (PARTITION BY p.u ORDER BY p.id, n.id) AS r FROM base p JOIN base n ON p.u = n.u AND p.label = 1 AND n.label = 0)
  SELECT u, pid, nid, g1, 1 AS y FROM pr WHERE r <= 32 UNION ALL SELECT u, pid, nid, -g1, 0 FROM pr WHERE r <= 32""")
def pair_expansion(b: Base) -> DataFrame:
    rows = b.scored()
    p, n = (rows.where(f"label = {y}").select("u", F.col("id").alias(f"{c}id"), F.col("s1").alias(c)) for y, c in ((1, "p"), (0, "n")))
    pairs = p.join(n, "u").withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("pid", "nid"))).where("r <= 32").select("u", "pid", "nid", r6(F.col("p") - F.col("n")).alias("g1"))
    return pairs.withColumn("y", F.lit(1)).unionByName(pairs.select("u", "pid", "nid", (-F.col("g1")).alias("g1"), F.lit(0).alias("y")))


@query("m04_tfidf_weight", "SELECT i, round(ln(((SELECT count(DISTINCT u) FROM train) + 1) / (count(*) + 1)) + 1, 6) AS w FROM train GROUP BY i")
def tfidf_weight(b: Base) -> DataFrame:
    return sim.tf_idf(b.train()).withColumn("w", r6(F.col("w")))


@query("m05_bm25_weight", """, l AS (SELECT u, count(*) AS len FROM train GROUP BY u), m AS (SELECT avg(len) AS mean, count(*) AS users FROM l)
  SELECT u, i, round(greatest(ln((users - pop + 0.5) / (pop + 0.5)), 0.0) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS w FROM train JOIN l USING (u) JOIN ipop USING (i) CROSS JOIN m""")
def bm25_weight(b: Base) -> DataFrame:
    return sim.bm25(b.train()).withColumn("w", r6(F.col("w")))


@query("m06_item_cosine", COS + " SELECT i, j, round(sim, 6) AS sim FROM sims")
def item_cosine(b: Base) -> DataFrame:
    return sim.cosine(b.train()).withColumn("sim", r6(F.col("sim")))


@query("m07_itemknn", COS + HIST + " SELECT id, round(sum(sim), 6) AS knn_sum, round(max(sim), 6) AS knn_max, round(list_avg(max(sim, 3)), 6) AS knn_top3, round(sum(sim * hours) / (sum(hours) + 1e-6), 6) AS knn_hours FROM hs GROUP BY id")
def itemknn(b: Base) -> DataFrame:
    train, cand = b.split()
    out = sim.item_knn(cand, train)
    return out.select("id", *[r6(F.col(c)).alias(c) for c in out.columns if c != "id"])


@query("k03_topk_mean", COS + HIST + " SELECT id, round(list_avg(max(sim, 5)), 6) AS top5, round(list_avg(max(sim, 10)), 6) AS top10 FROM hs GROUP BY id")
def topk_mean(b: Base) -> DataFrame:
    train, cand = b.split()
    sims = F.col("sims")
    return sim.history_cosines(cand, train).select("id", r6(sim.largest_mean(sims, 5)).alias("top5"), r6(sim.largest_mean(sims, 10)).alias("top10"))


@query("m08_normalised_cooc", CO + """, bth AS (SELECT i, j, s FROM co UNION ALL SELECT j, i, s FROM co)
  SELECT c.id, round(sum(ln(1 + coalesce(b.s, 0))), 6) AS raw, round(sum(coalesce(b.s, 0) / sqrt((coalesce(p.pop, 0) + 1) * (q.pop + 1))), 6) AS norm_sum, round(ln(1 + sum(coalesce(b.s, 0))), 6) AS raw_sum,
    round(sum(coalesce(b.s, 0) / sqrt((coalesce(p.pop, 0) + 1) * (q.pop + 1))) / count(*), 6) AS norm_mean, round(max(coalesce(b.s, 0) / sqrt((coalesce(p.pop, 0) + 1) * (q.pop + 1))), 6) AS norm_max, round(count(b.s) / count(*), 6) AS coverage
  FROM cand c JOIN train t ON t.u = c.u LEFT JOIN bth b ON b.i = c.i AND b.j = t.i LEFT JOIN ipop p ON p.i = c.i LEFT JOIN ipop q ON q.i = t.i GROUP BY c.id""")
def normalised_cooc(b: Base) -> DataFrame:
    train, cand = b.split()
    pop = train.groupBy("i").agg(F.count(F.lit(1)).alias("pop"))
    asks = cand.select("id", "u", "i").join(pop.withColumnRenamed("pop", "own"), "i", "left")
    rows = sim.history_sums(asks, train.join(pop, "i"), train.select("u", "i"), {"s": lambda a, b: None}, extra=("pop",))
    norm = F.zip_with("s", "pops", lambda s, p: s / F.sqrt((F.coalesce("own", F.lit(0)) + 1) * (p + 1)))
    rows = rows.select("id", "s", norm.alias("norm"), F.size("s").alias("n"))
    logs, met = F.transform("s", lambda s: F.log1p(s)), F.size(F.filter("s", lambda s: s > 0))
    return rows.select("id", r6(V.total(logs)).alias("raw"), r6(V.total("norm")).alias("norm_sum"), r6(F.log1p(V.total("s"))).alias("raw_sum"), r6(V.total("norm") / F.col("n")).alias("norm_mean"), r6(F.array_max("norm")).alias("norm_max"), r6(met / F.col("n")).alias("coverage"))


DECAY = """, dw AS (SELECT u, i, pow(0.5, date_diff('day', d, (SELECT max(d) FROM train)) / 365.0) AS w FROM train), dn AS (SELECT i, sqrt(sum(w * w)) AS norm FROM dw GROUP BY i),
  dc AS (SELECT a.i AS i, b.i AS j, sum(a.w * b.w) AS s FROM dw a JOIN dw b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2), dh AS (SELECT dc.i, dc.j, s / greatest(x.norm * y.norm, 1e-12) AS sim FROM dc JOIN dn x ON x.i = dc.i JOIN dn y ON y.i = dc.j),
  sims AS (SELECT i, j, sim FROM dh UNION ALL SELECT j, i, sim FROM dh)"""


@query("m10_time_decay_knn", DECAY + HIST + " SELECT id, round(sum(sim), 6) AS s FROM hs GROUP BY id")
def time_decay_knn(b: Base) -> DataFrame:
    train, cand = b.split()
    return sim.decayed_cosines(cand, train, (365.0,)).select("id", r6(V.total("sims_0")).alias("s"))


UCOS = """, uc AS (SELECT a.u AS u, b.u AS v, count(*) AS s FROM train a JOIN train b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2), un AS (SELECT u, sqrt(count(*)) AS norm FROM train GROUP BY u),
  uh AS (SELECT uc.u, uc.v, s / greatest(a.norm * b.norm, 1e-12) AS sim FROM uc JOIN un a ON a.u = uc.u JOIN un b ON b.u = uc.v), us AS (SELECT u, v, sim FROM uh UNION ALL SELECT v, u, sim FROM uh)"""


@query("j15_user_cosine", UCOS + " SELECT u AS i, v AS j, round(sim, 6) AS sim FROM us")
def user_cosine(b: Base) -> DataFrame:
    return sim.user_cosine(b.train()).withColumn("sim", r6(F.col("sim")))


@query("m11_userknn", UCOS + " SELECT c.id, round(sum(coalesce(us.sim, 0.0)), 6) AS uknn_sum, round(max(coalesce(us.sim, 0.0)), 6) AS uknn_max, round(list_avg(max(coalesce(us.sim, 0.0), 10)), 6) AS uknn_top10, round(sum(coalesce(us.sim, 0.0)) / sqrt(count(*) + 1), 6) AS uknn_norm FROM cand c JOIN train t ON t.i = c.i AND t.u <> c.u LEFT JOIN us ON us.u = c.u AND us.v = t.u GROUP BY c.id")
def userknn(b: Base) -> DataFrame:
    train, cand = b.split()
    out = sim.user_knn(cand, train)
    return out.select("id", *[r6(F.col(c)).alias(c) for c in out.columns if c != "id"])


@query("k06_item_neighbours", COS + """, rk AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS r FROM sims), lm AS (SELECT i, least(count(*), 10) AS n FROM rk GROUP BY i)
  SELECT lm.i, CAST(q.r AS INT) AS r, rk.j, round(rk.sim, 6) AS sim FROM lm CROSS JOIN (SELECT unnest(range(1, 11)) AS r) q JOIN rk ON rk.i = lm.i AND rk.r = least(q.r, lm.n)""")
def item_neighbours(b: Base) -> DataFrame:
    return sim.neighbours(sim.cosine(b.train(), by_item=True), 10).withColumn("sim", r6(F.col("sim")))


NORM = ", nm AS (SELECT t.u, t.i, 1.0::DOUBLE / sqrt(deg * pop) AS w FROM train t JOIN udeg USING (u) JOIN ipop USING (i)), gm AS (SELECT a.i AS i, b.i AS j, sum(a.w * b.w) AS sim FROM nm a JOIN nm b ON a.u = b.u GROUP BY 1, 2)"


@query("m13_graph_filter_linear", NORM + " SELECT c.id, round(sum(coalesce(g.sim, 0)), 6) AS s FROM cand c JOIN train t ON t.u = c.u LEFT JOIN gm g ON g.i = c.i AND g.j = t.i GROUP BY c.id")
def graph_filter_linear(b: Base) -> DataFrame:
    train, cand = b.split()
    return sim.linear_filter(cand, train).withColumn("s", r6(F.col("s")))


@query("m14_turbo_filter", NORM + """ SELECT c.id, round(sum(n.w * coalesce(g.sim, 0)), 6) AS linear_1, round(sum(n.w * coalesce(sign(g.sim) * pow(abs(g.sim), 2), 0)), 9) AS linear_2, round(sum(n.w * coalesce(sqrt(g.sim), 0)), 6) AS linear_half
  FROM cand c JOIN nm n ON n.u = c.u LEFT JOIN gm g ON g.i = c.i AND g.j = n.i GROUP BY c.id""")
def turbo_filter(b: Base) -> DataFrame:
    train, cand = b.split()
    out = sim.polynomial_filter(cand, train, (1.0, 2.0, 0.5))
    return out.select("id", r6(F.col("s_1")).alias("linear_1"), F.round("s_2", 9).alias("linear_2"), r6(F.col("s_3")).alias("linear_half"))


#: Vectors of users and items: rows of the table embeddings, chosen by the key.
VECTORS = """, em AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
  ue AS (SELECT u, p, x FROM udeg CROSS JOIN nv JOIN em ON vec_id = (u * 7 + 3) % n), ie AS (SELECT i, p, x FROM ipop CROSS JOIN nv JOIN em ON vec_id = i % n)"""


def vectors(b: Base, train: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    rows = b.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n, size = rows.agg(F.max("vec_id") + 1, F.max(F.size("v"))).first()
    users = train.select("u").distinct().withColumn("vec_id", (F.col("u") * 7 + 3) % n).join(rows, "vec_id").select("u", "v")
    items = train.select("i").distinct().withColumn("vec_id", F.col("i") % n).join(rows, "vec_id").select("i", "v")
    return users, items, size


TAG = """, ed AS (SELECT u, i, deg, pop FROM train JOIN udeg USING (u) JOIN ipop USING (i)), ua AS (SELECT u, p, avg(x) AS m, sum(x / sqrt(deg * pop)) AS s FROM ed JOIN ie USING (i) GROUP BY 1, 2),
  ia AS (SELECT i, p, avg(x) AS m, sum(x / sqrt(deg * pop)) AS s FROM ed JOIN ue USING (u) GROUP BY 1, 2), ut AS (SELECT u, p, 0.7 * x + 0.3 * m AS m, 0.7 * x + 0.3 * s AS s FROM ue JOIN ua USING (u, p)), it AS (SELECT i, p, 0.7 * x + 0.3 * m AS m, 0.7 * x + 0.3 * s AS s FROM ie JOIN ia USING (i, p)),
  ul AS (SELECT u, greatest(sqrt(sum(m * m)), 1e-12) AS lm, greatest(sqrt(sum(s * s)), 1e-12) AS ls FROM ut GROUP BY u), il AS (SELECT i, greatest(sqrt(sum(m * m)), 1e-12) AS km, greatest(sqrt(sum(s * s)), 1e-12) AS ks FROM it GROUP BY i)"""


@query("m15_tag_aggregation", VECTORS + TAG + " SELECT c.id, round(sum(a.m * b.m) / any_value(lm * km), 6) AS mean_unit, round(sum(a.s * b.s) / any_value(ls * ks), 6) AS sym_unit, round(sum(a.s * b.s), 6) AS sym FROM cand c JOIN ut a USING (u) JOIN it b ON b.i = c.i AND b.p = a.p JOIN ul USING (u) JOIN il ON il.i = c.i GROUP BY c.id")
def tag_aggregation(b: Base) -> DataFrame:
    """Users' and items' vectors drawn towards those of their neighbours, by means or by degrees, and their products."""
    train, cand = b.split()
    users, items, size = vectors(b, train)
    return graph.aggregated_scores(cand, train, users, items, size, 0.3).select("id", *[r6(F.col(c)).alias(c) for c in ("mean_unit", "sym_unit", "sym")])


PROFILE = """, mo AS (SELECT strftime(d, '%Y-%m') AS ym, count(*) / (SELECT count(*) FROM train) AS g FROM train GROUP BY 1), {parts}
  SELECT c.id, round(sum(pu.p * ln(pi.p / pi.g)), 6) AS s FROM cand c JOIN prof_u pu ON pu.key = c.u JOIN prof_i pi ON pi.key = c.i AND pi.ym = pu.ym GROUP BY c.id"""
PART = """oc_{k} AS (SELECT {k} AS key, strftime(d, '%Y-%m') AS ym, count(*) AS c FROM train GROUP BY 1, 2), prof_{k} AS (SELECT t.key, mo.ym, mo.g, greatest((coalesce(o.c, 0) + 20 * mo.g) / (t.t + 20), 1e-9) AS p
  FROM (SELECT key, sum(c) AS t FROM oc_{k} GROUP BY key) t CROSS JOIN mo LEFT JOIN oc_{k} o ON o.key = t.key AND o.ym = mo.ym)"""


@query("m17_temporal_overlap", PROFILE.format(parts=PART.format(k="u") + ", " + PART.format(k="i")))
def temporal_overlap(b: Base) -> DataFrame:
    train, cand = b.split()
    return sim.temporal_overlap(cand, train).withColumn("s", r6(F.col("s")))


@query("m27_propagation_layer", NORM + ", x AS (SELECT i, unnest([0, 1]) AS dim, unnest([ln(1 + pop), mean_t]) AS x FROM ipop) SELECT u, dim, round(sum(w * x), 6) AS x FROM nm JOIN x USING (i) GROUP BY 1, 2")
def propagation_layer(b: Base) -> DataFrame:
    train = b.train()
    items = train.groupBy("i").agg(F.log1p(F.count(F.lit(1))).alias("a"), F.avg("hours_t").alias("b"))
    long = items.select("i", F.explode(F.array(F.struct(F.lit(0).alias("dim"), F.col("a").alias("x")), F.struct(F.lit(1).alias("dim"), F.col("b").alias("x")))).alias("v")).select("i", "v.dim", "v.x")
    return graph.propagate(train.select("u", "i", F.lit(1.0).alias("w")), long).withColumn("x", r6(F.col("x")))


LAYERS = """, ed AS (SELECT u, i, 1 / sqrt(CAST(deg AS DOUBLE) * pop) AS w FROM train JOIN udeg USING (u) JOIN ipop USING (i)),
  u1 AS (SELECT u, p, sum(w * x) AS x FROM ed JOIN ie USING (i) GROUP BY 1, 2), i1 AS (SELECT i, p, sum(w * x) AS x FROM ed JOIN ue USING (u) GROUP BY 1, 2), u2 AS (SELECT u, p, sum(w * x) AS x FROM ed JOIN i1 USING (i) GROUP BY 1, 2), i2 AS (SELECT i, p, sum(w * x) AS x FROM ed JOIN u1 USING (u) GROUP BY 1, 2),
  uf AS (SELECT u, p, (a.x + b.x + c.x) / 3 AS x FROM ue a JOIN u1 b USING (u, p) JOIN u2 c USING (u, p)), jf AS (SELECT i, p, (a.x + b.x + c.x) / 3 AS x FROM ie a JOIN i1 b USING (i, p) JOIN i2 c USING (i, p))"""


@query("m27_layer_mean_scores", VECTORS + LAYERS + " SELECT c.id, round(sum(a.x * b.x), 6) AS s FROM cand c JOIN uf a USING (u) JOIN jf b ON b.i = c.i AND b.p = a.p GROUP BY c.id")
def layer_mean_scores(b: Base) -> DataFrame:
    """Dot products of users and items after two layers of propagation on both sides, layers averaged."""
    train, cand = b.split()
    users, items, size = vectors(b, train)
    return graph.dot_scores(cand, *graph.propagated(train, users, items, size, 2)).select("id", r6(F.col("s")).alias("s"))


@query("m33_residualise", "SELECT id, round(s3 - regr_slope(s3, s1) OVER () * s1 - regr_intercept(s3, s1) OVER (), 6) AS residual FROM base")
def residualise(b: Base) -> DataFrame:
    return stats.residual(b.scored(), "s3", "s1").select("id", r6(F.col("residual")).alias("residual"))


@query("e13_negative_control_guard", """, v AS (SELECT 's2' AS name, p2 AS p, * FROM preds UNION ALL SELECT 's3', p3, * FROM preds), f AS (SELECT name, count_if(p1 = label AND p <> label) - count_if(p1 <> label AND p = label) AS loss, count_if(p1 <> p AND abs(r1 - k - 0.5) > 1) AS far, count(*) AS n FROM v GROUP BY name),
  m AS (SELECT quantile_cont(loss / n, 0.5) AS md FROM f) SELECT name, round(loss / n + far / n * 0.1, 6) AS penalty, CASE WHEN loss / n + far / n * 0.1 > md THEN 'block' ELSE 'pass' END AS verdict FROM f CROSS JOIN m""")
def negative_control_guard(b: Base) -> DataFrame:
    rows = fusion.votes(b.scored(), ["s2", "s3"])
    rows = ranking.top_half(rows, "s1", pred="p1").select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"pred_{s}").alias("p")) for s in ("s2", "s3")])).alias("x")).select("*", "x.name", "x.p")
    far = F.count_if((F.col("p1") != F.col("p")) & (F.abs(F.col("rank_in_user") - F.col("k_in_user") - 0.5) > 1))
    out = evaluation.fix_break(rows, "p1", "p", ("name",)).join(rows.groupBy("name").agg(far.alias("far")), "name").withColumn("loss", -F.col("delta"))
    out = out.crossJoin(F.broadcast(out.agg(F.percentile("loss", 0.5).alias("md"))))
    penalty = F.col("loss") + F.col("far") / F.col("n_rows") * 0.1
    return out.select("name", r6(penalty).alias("penalty"), F.when(penalty > F.col("md"), "block").otherwise("pass").alias("verdict"))


TF = f"""WITH tk AS (SELECT source, lang, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) AS w FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM documents), df AS (SELECT w, count(DISTINCT source) AS df FROM tk GROUP BY w),
  a AS (SELECT source AS k, w, count(*) AS c FROM tk GROUP BY 1, 2), l AS (SELECT lang AS k, w, count(*) AS c FROM tk GROUP BY 1, 2),
  wa AS (SELECT k, w, c * (ln((n + 1) / (df + 1)) + 1) AS v FROM a JOIN df USING (w) CROSS JOIN n), wl AS (SELECT k, w, c * (ln((n + 1) / (df + 1)) + 1) AS v FROM l JOIN df USING (w) CROSS JOIN n)
  SELECT x.k AS source, y.k AS lang, round(sum(x.v * y.v) / (any_value(nx.n) * any_value(ny.n)), 6) AS cosine FROM wa x JOIN wl y USING (w) JOIN (SELECT k, sqrt(sum(v * v)) AS n FROM wa GROUP BY k) nx ON nx.k = x.k JOIN (SELECT k, sqrt(sum(v * v)) AS n FROM wl GROUP BY k) ny ON ny.k = y.k GROUP BY 1, 2"""


@query("m20_tfidf_profile_cosine", TF, frames=False)
def tfidf_profile_cosine(b: Base) -> DataFrame:
    docs = b.table("documents").select("source", "lang", F.explode(T.tokens("text")).alias("w"))
    groups = docs.select("source").distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = docs.groupBy("w").agg(F.count_distinct("source").alias("df")).crossJoin(F.broadcast(groups)).select("w", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    side = {}
    for key in ("source", "lang"):
        v = docs.groupBy(key, "w").agg(F.count(F.lit(1)).alias("c")).join(idf, "w").select(key, "w", (F.col("c") * F.col("idf")).alias(f"v_{key}"))
        side[key] = v.join(v.groupBy(key).agg(F.sqrt(F.sum(F.col(f"v_{key}") * F.col(f"v_{key}"))).alias(f"n_{key}")), key)
    both = side["source"].join(side["lang"], "w")
    return both.groupBy("source", "lang").agg(r6(F.sum(F.col("v_source") * F.col("v_lang")) / (F.first("n_source") * F.first("n_lang"))).alias("cosine"))


@query("m21_item_texts", "SELECT source, string_agg(text, ' | ' ORDER BY r) AS body, count(*) AS n FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS q FROM documents) WHERE q = 1) WHERE r <= 5 GROUP BY source", frames=False)
def item_texts(b: Base) -> DataFrame:
    """The five longest different texts of each source, whole. They are chosen by lengths and digests; only the chosen
    ones are read again and joined."""
    docs = b.table("documents").select("source", "doc_id", "n_chars", F.sha2("text", 256).alias("same"))
    one = docs.groupBy("source", "same").agg(F.min_by(F.struct("n_chars", "doc_id"), "doc_id").alias("x")).select("source", "x.*")
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 5")
    rows = b.table("documents").select("doc_id", "text").join(best, "doc_id")
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " | ").alias("body"), F.count(F.lit(1)).alias("n"))


EMB = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query("f08_vector_ops", EMB + " SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_avg(v), 6) AS mean, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] * p[2])), 6) AS mirrored, round(list_sum(list_sort(v, 'DESC')[1:3]), 6) AS top3 FROM e", frames=False)
def vector_ops(b: Base) -> DataFrame:
    rows = b.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    top = F.slice(F.sort_array("v", False), 1, 3)
    return rows.select("vec_id", r6(V.norm("v")).alias("norm"), r6(V.total(F.col("v")) / F.size("v")).alias("mean"), r6(V.dot("v", F.reverse("v"))).alias("mirrored"), r6(V.total(top)).alias("top3"))


@query("m23_centroid_cosine", EMB + """, u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e), c AS (SELECT label, p, avg(x) AS m FROM u GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label)
  SELECT vec_id, round(sum(x * m) / greatest(sqrt(sum(x * x)) * any_value(n), 1e-12), 6) AS cosine FROM u JOIN c USING (label, p) JOIN cn USING (label) GROUP BY vec_id""", frames=False)
def centroid_cosine(b: Base) -> DataFrame:
    rows = b.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centres = V.centroids(rows, "label", "v")
    return rows.join(centres, "label").select("vec_id", r6(V.cosine("v", "centroid")).alias("cosine"))
