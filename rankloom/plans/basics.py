"""Scans, projections, joins and roll-ups that the other queries are made of, each on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import evaluation, fusion, ranking, similarity, split, stats
from rankloom.plans.base import Base
from rankloom.plans.profile import draws
from rankloom.plans.registry import query
from rankloom.plans.scorers import UCOS
from rankloom.session import materialise
from rankloom.sources import io

r6 = lambda c: F.round(c, 6)
S = ["s1", "s2", "s3"]


@query("s05_selected_texts", "SELECT d.doc_id, d.text FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", frames=False)
def selected_texts(b: Base) -> DataFrame:
    wanted = b.table("labels").where("quality = 1").select("doc_id")
    return b.table("documents").join(wanted, "doc_id", "left_semi").select("doc_id", "text")


@query("s05_whole_texts", "SELECT d.doc_id, length(d.text) AS n, sha256(d.text) AS digest FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", frames=False)
def whole_texts(b: Base) -> DataFrame:
    """The digest stands for the text, every sign of which is read."""
    wanted = b.table("labels").where("quality = 1").select("doc_id")
    return b.table("documents").join(wanted, "doc_id", "left_semi").select("doc_id", F.char_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query("s06_score_scan", "SELECT id AS \"ID\", u AS \"userID\", i AS \"gameID\", s1 AS m_score_pop, s2 AS m_score_day FROM base")
def score_scan(b: Base) -> DataFrame:
    rows = b.scored().select(F.col("id").alias("ID"), F.col("u").alias("userID"), F.col("i").alias("gameID"), F.col("s1").alias("score_pop"), F.col("s2").alias("score_day"), "label")
    return io.scores(rows, prefix="m_")


@query("s08_ensemble", "SELECT id AS \"ID\", round((s1 + s2 + s3) / 3, 6) AS mean, round(sqrt((pow(s1 - (s1 + s2 + s3) / 3, 2) + pow(s2 - (s1 + s2 + s3) / 3, 2) + pow(s3 - (s1 + s2 + s3) / 3, 2)) / 3), 6) AS sd, CAST(3 AS BIGINT) AS n FROM base")
def ensemble(b: Base) -> DataFrame:
    rows = b.scored()
    files = [rows.select(F.col("id").alias("ID"), F.col(s).alias("score")) for s in S]
    return io.ensemble(files, "score").select("ID", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "n")


@query("s10_label_file", "SELECT id AS \"ID\", p1 AS label FROM preds")
def label_file(b: Base) -> DataFrame:
    return io.label_file(ranking.top_half(b.scored(), "s1").select(F.col("id").alias("ID"), F.col("pred").alias("Played")))


@query("s17_histogram", "SELECT CAST(floor(hours / 10) AS BIGINT) AS bin, count(*) AS n FROM inter GROUP BY 1")
def histogram(b: Base) -> DataFrame:
    return b.interactions().groupBy(F.floor(F.col("hours") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("p01_derived", "SELECT id, round(s1 * s3, 6) AS product, round(s1 - s2, 6) AS difference, round(log2(1 + deg), 6) AS log_deg FROM base")
def derived(b: Base) -> DataFrame:
    return b.scored().select("id", r6(F.col("s1") * F.col("s3")).alias("product"), r6(F.col("s1") - F.col("s2")).alias("difference"), r6(F.log2(1 + F.col("deg"))).alias("log_deg"))


@query("p04_membership", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)", frames=False)
def membership(b: Base) -> DataFrame:
    parts = b.table("part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return b.table("lineitem").join(parts, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("p06_masks", "SELECT id, CAST((r1 > k - 2 AND r1 <= k + 2) AND (p2 + p3 >= 1) AND deg > 20 AS INT) AS chosen FROM preds")
def masks(b: Base) -> DataFrame:
    rows = ranking.top_half(fusion.votes(b.scored(), ["s2", "s3"]), "s1")
    return rows.select("id", (ranking.in_band(2) & (F.col("votes") >= 1) & (F.col("deg") > 20)).cast("int").alias("chosen"))


@query("p07_floored_ratio", "SELECT u, round(avg(hours) / greatest(coalesce(stddev_samp(hours), 1), 1), 6) AS ratio FROM inter GROUP BY u")
def floored_ratio(b: Base) -> DataFrame:
    return b.interactions().groupBy("u").agg(r6(F.avg("hours") / F.greatest(F.coalesce(F.stddev_samp("hours"), F.lit(1.0)), F.lit(1.0))).alias("ratio"))


@query("j01_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", frames=False)
def inner_join(b: Base) -> DataFrame:
    customers = b.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return b.table("orders").join(customers, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("j02_left_join", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey", frames=False)
def left_join(b: Base) -> DataFrame:
    counts = b.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return b.table("customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j03_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", frames=False)
def lookup(b: Base) -> DataFrame:
    places = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return b.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j04_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", frames=False)
def semi_join(b: Base) -> DataFrame:
    urgent = b.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return b.table("customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("j05_anti_join", "SELECT u, i FROM train")
def anti_join(b: Base) -> DataFrame:
    inter = b.interactions()
    return inter.join(split.hold_out(inter), ["u", "i"], "left_anti").select("u", "i")


@query("j06_star_merge", "SELECT id, s1, s2, s3 FROM base")
def star_merge(b: Base) -> DataFrame:
    rows = b.scored()
    out = rows.select("id", "s1")
    for s in S[1:]:
        out = out.join(rows.select("id", s), "id")
    return out


@query("j16_overlap_count", "SELECT (SELECT count(*) FROM cand SEMI JOIN inter USING (u, i)) AS seen, (SELECT count(*) FROM cand) AS n")
def overlap_count(b: Base) -> DataFrame:
    cand = b.candidates()
    seen = b.interactions().select("u", "i", F.lit(1).alias("seen"))
    return cand.join(seen, ["u", "i"], "left").agg(F.count("seen").alias("seen"), F.count(F.lit(1)).alias("n"))


@query("a16_place_audit", "SELECT r1 AS place, count_if(p1 <> p2) AS changed, count_if(p1 <> label AND p2 = label) AS fixes, count_if(p1 = label AND p2 <> label) AS breaks FROM preds GROUP BY r1")
def place_audit(b: Base) -> DataFrame:
    rows = ranking.top_half(b.scored(), "s2", pred="p2").drop("rank_in_user", "k_in_user")
    rows = ranking.top_half(rows, "s1", pred="p1")
    return evaluation.fix_break(rows, "p1", "p2", ("rank_in_user",)).select(F.col("rank_in_user").alias("place"), "changed", "fixes", "breaks")


FOLD = "CAST(CAST('0x' || substr(md5('fold:' || u), 1, 15) AS BIGINT) % 5 AS INT)"


@query("a17_split_rollup", f""", v AS (SELECT 's2' AS variant, {FOLD} AS fold, count_if(p1 <> label AND p2 = label) AS f, count_if(p1 = label AND p2 <> label) AS b, count(*) AS n FROM preds GROUP BY 2
  UNION ALL SELECT 's3', {FOLD}, count_if(p1 <> label AND p3 = label), count_if(p1 = label AND p3 <> label), count(*) FROM preds GROUP BY 2)
  SELECT variant, round(avg((f - b) / n), 6) AS mean_delta, round(min((f - b) / n), 6) AS worst, round(max((f - b) / n), 6) AS best, count_if(f > b) AS positive, CAST(sum(f) AS BIGINT) AS fixes, CAST(sum(b) AS BIGINT) AS breaks FROM v GROUP BY variant HAVING count(*) = 5""")
def split_rollup(b: Base) -> DataFrame:
    rows = fusion.votes(b.scored(), S)
    rows = rows.join(split.folds(rows.select("u").distinct(), 5), "u")
    long = rows.select("fold", "label", "pred_s1", F.explode(F.array(*[F.struct(F.lit(s).alias("variant"), F.col(f"pred_{s}").alias("p")) for s in ("s2", "s3")])).alias("x")).select("fold", "label", "pred_s1", "x.*")
    each = evaluation.fix_break(long, "pred_s1", "p", ("variant", "fold"))
    out = each.groupBy("variant").agg(r6(F.avg("delta")).alias("mean_delta"), r6(F.min("delta")).alias("worst"), r6(F.max("delta")).alias("best"), F.count_if(F.col("fixes") > F.col("breaks")).alias("positive"), F.sum("fixes").alias("fixes"), F.sum("breaks").alias("breaks"), F.count(F.lit(1)).alias("n"))
    return out.where("n = 5").drop("n")


@query("k01_mixed_sort", "SELECT u, id, s1, label FROM base ORDER BY u, s1 DESC, label, id")
def mixed_sort(b: Base) -> DataFrame:
    return b.scored().select("u", "id", "s1", "label").orderBy("u", F.desc("s1"), "label", "id")


@query("k01_whole_sort", "SELECT u, id, s1 FROM base ORDER BY u, s1 DESC, id")
def whole_sort(b: Base) -> DataFrame:
    return b.scored().select("u", "id", "s1").orderBy("u", F.desc("s1"), "id")


@query("k08_group_largest", "SELECT i, u, hours FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY hours DESC, u) AS r FROM inter) WHERE r <= 3")
def group_largest(b: Base) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.desc("hours"), "u")
    return b.interactions().withColumn("r", F.row_number().over(w)).where("r <= 3").select("i", "u", "hours")


@query("n01_hold_out_sizes", "SELECT u, k FROM sizes")
def hold_out_sizes(b: Base) -> DataFrame:
    return split.hold_out_sizes(b.interactions())


@query("f04_date_affinity", "SELECT id, round(-abs(day_u - day_i) / 365.0, 6) AS affinity FROM cand JOIN ipop USING (i) JOIN udeg USING (u)")
def date_affinity(b: Base) -> DataFrame:
    train, cand = b.split()
    mean = {k: train.groupBy(k).agg(F.avg(F.unix_date("d")).alias(f"day_{k}")) for k in "ui"}
    return cand.join(mean["i"], "i").join(mean["u"], "u").select("id", r6(-F.abs(F.col("day_u") - F.col("day_i")) / 365.0).alias("affinity"))


@query("m08_pair_lift", ", co AS (SELECT a.i AS i, b.i AS j, count(*) AS s FROM train a JOIN train b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2) SELECT co.i, co.j, round(s / sqrt((a.pop + 1) * (b.pop + 1)), 6) AS lift FROM co JOIN ipop a ON a.i = co.i JOIN ipop b ON b.i = co.j")
def pair_lift(b: Base) -> DataFrame:
    train = b.train()
    return similarity.counted_pairs(train).select("i", "j", r6(F.col("s") / F.sqrt((F.col("pi") + 1) * (F.col("pj") + 1))).alias("lift"))


#: Powers of popularity by which negatives are drawn, and the weights.
ALPHAS = {"0": (0.0, "1000"), "h": (0.5, "1000 * sqrt(p0 + 1)"), "1": (1.0, "1000 * (p0 + 1)")}
GRID = "".join(draws(w, "g:", n).replace("wt AS", f"wt{n} AS").replace("FROM wt ", f"FROM wt{n} ").replace("cum", f"cum{n}").replace(" al ", f" al{n} ").replace("JOIN al)", f"JOIN al{n})").replace("dr AS", f"dr{n} AS").replace("FROM dr ", f"FROM dr{n} ").replace("pk ", f"pk{n} ") for n, (_, w) in ALPHAS.items())
GRID += ", mixed AS (" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, coalesce(pop, 0) AS pop, 0 AS label FROM neg_{n} LEFT JOIN ipop USING (i) UNION ALL SELECT {a}::DOUBLE, coalesce(pop, 0), 1 FROM held LEFT JOIN ipop USING (i)" for n, (a, _) in ALPHAS.items()) + ")"


@query("n10_generator_grid", GRID + " SELECT alpha, round(max(abs(a / na - m / nb)), 6) AS ks FROM (SELECT DISTINCT alpha, pop, CAST(count_if(label = 1) OVER (PARTITION BY alpha ORDER BY pop) AS DOUBLE) AS a, count_if(label = 0) OVER (PARTITION BY alpha ORDER BY pop) AS m, count_if(label = 1) OVER (PARTITION BY alpha) AS na, count_if(label = 0) OVER (PARTITION BY alpha) AS nb FROM mixed) GROUP BY alpha")
def generator_grid(b: Base) -> DataFrame:
    """alpha, ks: how far the popularity of negatives drawn by (popularity + 1) ^ alpha is from that of the held-out items."""
    pops, sizes = materialise(b.popularity(), "popularity"), split.hold_out_sizes(b.stored())
    held, out = split.hold_out(b.stored()).select("i", F.lit(1).alias("label")), None
    for alpha, _ in ALPHAS.values():
        items = pops.select("i", F.floor(1000 * F.pow(F.col("pop") + 1, F.lit(alpha))).alias("w"))
        drawn = split.weighted_negatives(sizes, items, b.stored(), "g:").select("i", F.lit(0).alias("label"))
        rows = held.unionByName(drawn).withColumn("alpha", F.lit(alpha))
        out = rows if out is None else out.unionByName(rows)
    return stats.ks(out.join(pops, "i"), "pop", F.col("label") == 1, ("alpha",)).select("alpha", r6(F.col("ks")).alias("ks"))


@query("k05_neighbour_consensus", UCOS + """, nb AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY round(sim, 9) DESC, v) AS r FROM us)
  SELECT c.id, count(t.u) AS holders, round(count(t.u) / 10, 6) AS rate FROM cand c JOIN nb ON nb.u = c.u AND nb.r <= 10 LEFT JOIN train t ON t.u = nb.v AND t.i = c.i GROUP BY c.id""")
def neighbour_consensus(b: Base) -> DataFrame:
    """id, holders, rate: how many of the user's ten nearest users hold the item."""
    train, cand = b.split()
    near = similarity.nearest_users(train, 10).select("u", "v")
    held = train.select(F.col("u").alias("v"), "i", F.lit(1).alias("has"))
    rows = cand.select("id", "u", "i").join(near, "u").join(held, ["v", "i"], "left")
    return rows.groupBy("id").agg(F.count("has").alias("holders"), r6(F.count("has") / 10).alias("rate"))


@query("n13_training_pairs", """, pc AS (SELECT u, i, 0.5 + 0.5 * (rank() OVER (PARTITION BY u ORDER BY hours) + (count(*) OVER (PARTITION BY u, hours) - 1) / 2) / count(*) OVER (PARTITION BY u) AS w, row_number() OVER (PARTITION BY u ORDER BY md5('t:' || u || ':' || i), i) AS r FROM train)
  SELECT u, i, round(w, 6) AS w FROM pc WHERE r <= 20""")
def training_pairs(b: Base) -> DataFrame:
    """u, i, w: at most 20 positives of each user, by hash, with a confidence from the rank of their hours."""
    share = ranking.average_rank("hours") / F.count(F.lit(1)).over(ranking.by_user())
    r = F.row_number().over(Window.partitionBy("u").orderBy(split.hash_key("t:", "u", "i"), "i"))
    return b.train().select("u", "i", r6(0.5 + 0.5 * share).alias("w"), r.alias("r")).where("r <= 20").drop("r")
