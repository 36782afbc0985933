"""Profiling queries: counts, distributions, splits and simple functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import graph, ranking, split, stats
from rankloom.plans.base import Base
from rankloom.plans.registry import query
from rankloom.session import materialise

r6 = lambda c: F.round(c, 6)


@query("n08_split_candidates", "SELECT id, u, i, label FROM cand")
def split_candidates(b: Base) -> DataFrame:
    return b.candidates()


@query("n08_split_checks", """SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT id) AS ids,
  (SELECT count(*) FROM cand SEMI JOIN train USING (u, i)) AS overlap, (SELECT count(*) FROM (SELECT u FROM cand GROUP BY u HAVING sum(label) * 2 <> count(*))) AS uneven_users,
  count(DISTINCT u) AS users, (SELECT count(*) FROM (SELECT DISTINCT u FROM cand) ANTI JOIN (SELECT DISTINCT u FROM train) USING (u)) AS cold_users FROM cand""")
def split_checks(b: Base) -> DataFrame:
    return split.checks(*b.split())


@query("n02_recent_hold_out", "SELECT u, i FROM (SELECT u, i, k, row_number() OVER (PARTITION BY u ORDER BY d DESC, i) AS r FROM inter JOIN sizes USING (u)) WHERE r <= k")
def recent_hold_out(b: Base) -> DataFrame:
    return split.hold_out(b.interactions(), order="recent")


@query("n03_uniform_negatives", "SELECT u, i FROM negs")
def uniform_negatives(b: Base) -> DataFrame:
    inter = b.stored()
    return split.whole_negatives(split.hold_out_sizes(inter), b.items(), inter, "42n:")


#: Draws by weight from all items: a number below the sum of the weights meets the item in whose stretch it lies. Enough
#: draws that all users get what they want.
DRAWS = """, wt AS (SELECT {keys}p_partkey AS i, CAST(floor({weight}) AS BIGINT) AS w FROM (SELECT *, coalesce(pop, 0) AS p0 FROM part LEFT JOIN ipop ON i = p_partkey) q {bins}),
  cum AS (SELECT *, sum(w) OVER ({by} ORDER BY i) - w AS lo, sum(w) OVER ({by} ORDER BY i) AS hi FROM wt WHERE w > 0), al AS (SELECT {keys}CAST(max(hi) AS BIGINT) AS total FROM cum {group}),
  dr AS (SELECT *, CAST('0x' || substr(md5('{seed}' || u || ':' || {hash}j), 1, 15) AS BIGINT) % total AS x FROM (SELECT u, {keys}k, unnest(range(0, k * 60)) AS j FROM {sizes}) {all}),
  pk AS (SELECT u, {keys}k, i, min(j) AS j FROM dr ASOF JOIN cum {on} GROUP BY ALL), neg_{name} AS (SELECT u, {keys}i FROM (SELECT *, row_number() OVER (PARTITION BY u{comma} ORDER BY j) AS r FROM pk WHERE (u, i) NOT IN (SELECT (u, i) FROM inter)) WHERE r <= k)"""


def draws(weight: str, seed: str, name: str = "w") -> str:
    return DRAWS.format(keys="", weight=weight, bins="", by="", group="", seed=seed, hash="", sizes="sizes", all="CROSS JOIN al", on="ON x >= lo", comma="", name=name)


@query("n04_sqrtpop_negatives", draws("1000 * sqrt(p0)", "w:") + " SELECT u, i FROM neg_w")
def sqrtpop_negatives(b: Base) -> DataFrame:
    items = b.popularity().select("i", F.floor(1000 * F.sqrt("pop")).alias("w"))
    return split.weighted_negatives(split.hold_out_sizes(b.stored()), items, b.stored(), "w:")


#: Bins of equal numbers of items by popularity.
BINS = 10
BINNED = DRAWS.format(keys="bin, ", weight="1000 * sqrt(p0)", bins="JOIN pb ON pb.i = p_partkey", by="PARTITION BY bin", group="GROUP BY bin", seed="b:", hash="bin || ':' || ", sizes="wanted", all="JOIN al USING (bin)", on="ON dr.bin = cum.bin AND x >= lo", comma=", bin", name="b")
BINNED = BINNED.replace("SELECT u, bin, k, i, min(j)", "SELECT u, dr.bin, k, i, min(j)")
POPBIN = f""", pb AS (SELECT i, CAST(CASE WHEN n > 1 THEN greatest(0, ceil({BINS} * (r - 1) / (n - 1)) - 1) ELSE 0 END AS INT) AS bin FROM (SELECT p_partkey AS i, row_number() OVER (ORDER BY coalesce(pop, 0), p_partkey) AS r, count(*) OVER () AS n FROM part LEFT JOIN ipop ON i = p_partkey)),
  wanted AS (SELECT u, bin, count(*) AS k FROM held JOIN pb USING (i) GROUP BY 1, 2)"""


@query("n05_popbin_negatives", POPBIN + BINNED + " SELECT u, i, CAST(1 AS INT) AS in_bin FROM neg_b")
def popbin_negatives(b: Base) -> DataFrame:
    """As many unseen items of each popularity bin as the user's held-out items have, drawn by the root of popularity."""
    items = materialise(ranking.binned_counts(b.popularity(), "pop", BINS).select("i", "bin", F.floor(1000 * F.sqrt("pop")).alias("w")), "bins")
    wanted = split.hold_out(b.stored()).join(items, "i").groupBy("u", "bin").agg(F.count(F.lit(1)).alias("k"))
    return split.binned_negatives(wanted, items, b.stored(), "b:")


@query("n09_edge_dropout", "SELECT u, i FROM train WHERE (CAST('0x' || substr(md5('drop:' || u || ':' || i), 1, 15) AS BIGINT) + 1) / 1152921504606846977.0::DOUBLE >= 0.1")
def edge_dropout(b: Base) -> DataFrame:
    return split.edge_dropout(b.train().select("u", "i"), 0.1, "drop:")


@query("n11_user_folds", "SELECT u, CAST(CAST('0x' || substr(md5('fold:' || u), 1, 15) AS BIGINT) % 5 AS INT) AS fold FROM (SELECT DISTINCT u FROM inter)")
def user_folds(b: Base) -> DataFrame:
    return split.folds(b.interactions().select("u").distinct(), 5)


@query("a01_item_popularity", "SELECT i, count(*) AS pop, CAST(sum(n) AS BIGINT) AS events FROM inter GROUP BY i")
def item_popularity(b: Base) -> DataFrame:
    return b.interactions().groupBy("i").agg(F.count(F.lit(1)).alias("pop"), F.sum("n").alias("events"))


def key_stats(rows: DataFrame, key: str, other: str) -> DataFrame:
    h = "hours"
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(other).alias("others"), r6(F.sum(h)).alias("hours_sum"), r6(F.avg(h)).alias("hours_mean"), r6(F.percentile(h, 0.5)).alias("hours_median"), r6(F.coalesce(F.stddev_samp(h), F.lit(0.0))).alias("hours_sd"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.datediff(F.max("d"), F.min("d")).alias("day_span"))


STATS = """SELECT {key}, count(*) AS n_rows, count(DISTINCT {other}) AS others, round(sum(hours), 6) AS hours_sum, round(avg(hours), 6) AS hours_mean, round(quantile_cont(hours, 0.5), 6) AS hours_median,
  round(coalesce(stddev_samp(hours), 0.0), 6) AS hours_sd, min(d) AS first_day, max(d) AS last_day, CAST(date_diff('day', min(d), max(d)) AS INT) AS day_span FROM inter GROUP BY {key}"""


@query("a02_user_stats", STATS.format(key="u", other="i"))
def user_stats(b: Base) -> DataFrame:
    return key_stats(b.interactions(), "u", "i")


@query("a02_item_stats", STATS.format(key="i", other="u"))
def item_stats(b: Base) -> DataFrame:
    return key_stats(b.interactions(), "i", "u")


@query("a03_distinct_counts", "SELECT count(DISTINCT u) AS users, count(DISTINCT i) AS items, count(DISTINCT d) AS days FROM inter")
def distinct_counts(b: Base) -> DataFrame:
    return b.interactions().agg(F.count_distinct("u").alias("users"), F.count_distinct("i").alias("items"), F.count_distinct("d").alias("days"))


@query("a04_conditional_rates", "SELECT u, count_if(hours > 30) AS long_rows, round(avg(CAST(hours > 30 AS INT)), 6) AS long_rate, round(avg(early), 6) AS early_rate FROM inter GROUP BY u")
def conditional_rates(b: Base) -> DataFrame:
    return b.interactions().groupBy("u").agg(F.count_if(F.expr("hours > 30")).alias("long_rows"), r6(F.avg((F.col("hours") > 30).cast("int"))).alias("long_rate"), r6(F.avg("early")).alias("early_rate"))


@query("a05_user_histories", "SELECT u, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS items, count(*) AS n FROM train GROUP BY u")
def user_histories(b: Base) -> DataFrame:
    return b.train().groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_set("i")), lambda x: x.cast("string")), ",").alias("items"), F.count(F.lit(1)).alias("n"))


@query("a06_percentile_summary", "SELECT count(hours) AS n, round(avg(hours), 6) AS mean, round(stddev_pop(hours), 6) AS sd, min(hours) AS lo, max(hours) AS hi, " + ", ".join(f"round(quantile_cont(hours, {p}), 6) AS p{round(100 * p):02d}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM inter")
def percentile_summary(b: Base) -> DataFrame:
    out = stats.percentiles(b.interactions(), "hours")
    return out.select(*[c if c in ("n", "lo", "hi") else r6(F.col(c)).alias(c) for c in out.columns])


@query("a07_year_counts", "SELECT CAST(year(d) AS INT) AS year, count(*) AS n, count(DISTINCT u) AS users FROM inter GROUP BY 1")
def year_counts(b: Base) -> DataFrame:
    return b.interactions().groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("users"))


def covered(b: Base) -> DataFrame:
    """Items by popularity (ties by item) with the running sum, made from the histogram of popularity."""
    items = b.interactions().groupBy("i").agg(F.count(F.lit(1)).alias("pop"))
    hist = stats.running(items.groupBy("pop").agg(F.count(F.lit(1)).alias("c")).withColumn("mass", F.col("pop") * F.col("c")), "pop", "mass", descending=True)
    r = F.row_number().over(Window.partitionBy("pop").orderBy("i"))
    return items.join(hist, "pop").withColumn("cum", F.col("upto") - F.col("mass") + r * F.col("pop")).select("i", "pop", "cum", "total")


COVER = ", c AS (SELECT i, pop, CAST(sum(pop) OVER (ORDER BY pop DESC, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(pop) OVER () AS BIGINT) AS total FROM (SELECT i, count(*) AS pop FROM inter GROUP BY i))"


@query("a08_popularity_cover_labels", COVER + " SELECT id, u, cand.i, CAST(c.cum - c.pop <= c.total / 2 AS INT) AS pred FROM cand JOIN c USING (i)")
def popularity_cover_labels(b: Base) -> DataFrame:
    return b.candidates().join(covered(b), "i").select("id", "u", "i", (F.col("cum") - F.col("pop") <= F.col("total") / 2).cast("int").alias("pred"))


@query("a09_coverage_points", COVER + " SELECT p AS point, count_if(cum < p * total) + 1 AS items FROM c CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95])::DOUBLE AS p) GROUP BY p")
def coverage_points(b: Base) -> DataFrame:
    return covered(b).select("cum", "total", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95)))).alias("point")).groupBy("point").agg((F.count_if(F.col("cum") < F.col("point") * F.col("total")) + 1).alias("items"))


@query("w12_running_coverage", COVER + " SELECT i, pop, cum, round(cum / total, 6) AS share FROM c")
def running_coverage(b: Base) -> DataFrame:
    return covered(b).select("i", "pop", "cum", r6(F.col("cum") / F.col("total")).alias("share"))


@query("a10_gini", "SELECT round(2 * sum(r * pop) / (count(*) * sum(pop)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT pop, row_number() OVER (ORDER BY pop) AS r FROM (SELECT count(*) AS pop FROM inter GROUP BY i))")
def gini(b: Base) -> DataFrame:
    return stats.gini(b.interactions().groupBy("i").agg(F.count(F.lit(1)).alias("pop")), "pop").select(r6(F.col("gini")).alias("gini"))


@query("a11_ks_two_sample", "SELECT round(max(abs(a / na - m / nb)), 6) AS ks FROM (SELECT DISTINCT pop, CAST(count_if(label = 1) OVER (ORDER BY pop) AS DOUBLE) AS a, count_if(label = 0) OVER (ORDER BY pop) AS m, count_if(label = 1) OVER () AS na, count_if(label = 0) OVER () AS nb FROM base)")
def ks_two_sample(b: Base) -> DataFrame:
    return stats.ks(b.scored(), "pop", F.col("label") == 1).select(r6(F.col("ks")).alias("ks"))


@query("a12_corr_log", "SELECT round(corr(ln(1 + n), ln(1 + hours)), 6) AS r, round(corr(ln(1 + hours), date_diff('day', DATE '1970-01-01', d)), 6) AS r_day, CAST(NULL AS DOUBLE) AS r_flat FROM inter")
def corr_log(b: Base) -> DataFrame:
    return b.interactions().agg(r6(stats.correlation(F.log1p("n"), F.log1p("hours"))).alias("r"), r6(stats.correlation(F.log1p("hours"), F.unix_date("d"))).alias("r_day"), r6(stats.correlation(F.lit(1.0), F.col("hours"))).alias("r_flat"))


AUC = "(sum((r + (c - 1) / 2) * {y}) - sum({y}) * (sum({y}) + 1) / 2) / (sum({y}) * sum(1 - {y}))"


@query("a13_rank_auc", "SELECT quality_side, round(" + AUC.format(y="y") + ", 6) AS auc FROM (SELECT 'toxic' AS quality_side, toxic AS y, rank() OVER (ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY n_chars) AS c FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'quality', quality, rank() OVER (ORDER BY n_chars), count(*) OVER (PARTITION BY n_chars) FROM documents JOIN labels USING (doc_id)) GROUP BY 1", frames=False)
def rank_auc(b: Base) -> DataFrame:
    rows = b.table("documents").select("doc_id", "n_chars").join(b.table("labels"), "doc_id")
    both = rows.select("n_chars", F.explode(F.create_map(F.lit("toxic"), "toxic", F.lit("quality"), "quality")).alias("quality_side", "y"))
    return stats.auc(both, "n_chars", "y", ("quality_side",)).select("quality_side", r6(F.col("auc")).alias("auc"))


@query("a14_weighted_mean", "SELECT u, round(sum(CASE WHEN n > 1 THEN hours_t * (n - 1) END) / sum(CASE WHEN n > 1 THEN n - 1 END), 6) AS mean FROM inter GROUP BY u")
def weighted_mean(b: Base) -> DataFrame:
    w = F.when(F.col("n") > 1, F.col("n") - 1)
    return b.interactions().groupBy("u").agg(r6(F.sum(F.col("hours_t") * w) / F.nullif(F.sum(w), F.lit(0))).alias("mean"))


@query("a15_bucket_accuracy", "SELECT CASE WHEN deg <= 20 THEN 'to20' WHEN deg <= 35 THEN 'to35' ELSE 'over' END AS bucket, count(*) AS n, round(avg(CAST(p1 = label AS INT)), 6) AS accuracy, count_if(p1 = 1 AND label = 0) AS fp, count_if(p1 = 0 AND label = 1) AS fn FROM preds GROUP BY 1")
def bucket_accuracy(b: Base) -> DataFrame:
    rows = ranking.top_half(b.scored(), "s1")
    bucket = F.when(F.col("deg") <= 20, "to20").when(F.col("deg") <= 35, "to35").otherwise("over")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") == F.col("label")).cast("int"))).alias("accuracy"), F.count_if(F.expr("pred = 1 and label = 0")).alias("fp"), F.count_if(F.expr("pred = 0 and label = 1")).alias("fn"))


@query("a18_density_duplicates", "SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS events, count_if(n > 1) AS repeated, round(count(*) / (count(DISTINCT u) * count(DISTINCT i)), 9) AS density FROM inter")
def density(b: Base) -> DataFrame:
    return b.interactions().agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("events"), F.count_if(F.expr("n > 1")).alias("repeated"), F.round(F.count(F.lit(1)) / (F.count_distinct("u") * F.count_distinct("i")), 9).alias("density"))


@query("a19_group_documents", "SELECT lang, count(*) AS n, left(string_agg(text, chr(10) ORDER BY doc_id), 20000) AS body FROM documents GROUP BY lang", frames=False)
def group_documents(b: Base) -> DataFrame:
    """The whole texts of a group joined in order, of which the first 20,000 signs are the group's document."""
    return T.joined_texts(b.table("documents"), "lang", "doc_id", "text", most=20_000)


@query("a20_month_profile", """, m AS (SELECT DISTINCT strftime(d, '%Y-%m') AS ym FROM inter), g AS (SELECT strftime(d, '%Y-%m') AS ym, count(*) / (SELECT count(*) FROM inter) AS p FROM inter GROUP BY 1),
  c AS (SELECT i, strftime(d, '%Y-%m') AS ym, count(*) AS c FROM inter GROUP BY 1, 2), t AS (SELECT i, count(*) AS n FROM inter GROUP BY 1)
  SELECT t.i, g.ym, round(greatest((coalesce(c.c, 0) + 20 * g.p) / (t.n + 20), 1e-9), 9) AS p FROM t CROSS JOIN g LEFT JOIN c ON c.i = t.i AND c.ym = g.ym""")
def month_profile(b: Base) -> DataFrame:
    return T.month_profile(b.interactions(), "i", 20.0).select("i", "ym", F.round("p", 9).alias("p"))


@query("a21_components", """, e AS (SELECT u * 2 AS a, i * 2 + 1 AS b FROM inter), sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e), first AS (SELECT min(a) AS a FROM sides),
  reach AS (WITH RECURSIVE r(node) AS (SELECT a FROM first UNION SELECT b.b FROM r JOIN sides b ON b.a = r.node) SELECT node FROM r)
  SELECT node, (SELECT a FROM first) AS component FROM reach""")
def first_component(b: Base) -> DataFrame:
    """The nodes of the component of the smallest node, of the components of all interactions: users are even numbers,
    items odd ones. The other components are in a21_component_sizes."""
    edges = b.interactions().select((F.col("u") * 2).alias("a"), (F.col("i") * 2 + 1).alias("b"))
    labels = graph.components(edges)
    return labels.join(F.broadcast(labels.agg(F.min("node").alias("component"))), "component").select("node", "component")


@query("a21_component_sizes")
def component_sizes(b: Base) -> DataFrame:
    """The size histogram of the components of all interactions, and beside each row their number, the largest and its
    share of the nodes. Without SQL; tested against union-find."""
    edges = b.interactions().select((F.col("u") * 2).alias("a"), (F.col("i") * 2 + 1).alias("b"))
    sizes = graph.component_sizes(graph.components(edges))
    totals = sizes.agg(F.sum("n").alias("components"), F.max("size").alias("largest"), r6(F.max("size") / F.sum(F.col("size") * F.col("n"))).alias("largest_share"))
    return sizes.crossJoin(F.broadcast(totals))


@query("a22_model_agreement", "SELECT CAST((p1 = label)::INT + (p2 = label)::INT + (p3 = label)::INT AS INT) AS right_models, count(*) AS n FROM preds GROUP BY 1")
def model_agreement(b: Base) -> DataFrame:
    rows = b.scored()
    for s in ("s1", "s2", "s3"):
        rows = ranking.top_half(rows, s, pred=f"p_{s}")
    return rows.groupBy(sum((F.col(f"p_{s}") == F.col("label")).cast("int") for s in ("s1", "s2", "s3")).alias("right_models")).agg(F.count(F.lit(1)).alias("n"))


@query("a23_candidate_surplus", """, ci AS (SELECT i, count(*) AS n FROM cand GROUP BY i), md AS (SELECT quantile_cont(n, 0.5) AS md FROM ci), tot AS (SELECT count(*) AS n_cand, (SELECT count(*) FROM train) AS n_train FROM cand)
  SELECT i, n, round((n - pop * n_cand / n_train) / sqrt(pop * n_cand / n_train + 1) * n / (n + md), 6) AS surplus FROM ci JOIN ipop USING (i) CROSS JOIN md CROSS JOIN tot""")
def candidate_surplus(b: Base) -> DataFrame:
    train, cand = b.split()
    items = cand.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    totals = items.agg(F.sum("n").alias("n_cand")).crossJoin(stats.quantiles(items, {"md": ("n", 0.5)})).crossJoin(train.agg(F.count(F.lit(1)).alias("n_train")))
    rows = items.join(train.groupBy("i").agg(F.count(F.lit(1)).alias("pop")), "i").crossJoin(F.broadcast(totals))
    mean = F.col("pop") * F.col("n_cand") / F.col("n_train")
    return rows.select("i", "n", r6((F.col("n") - mean) / F.sqrt(mean + 1) * F.col("n") / (F.col("n") + F.col("md"))).alias("surplus"))


@query("p02_median_fill", "SELECT vec_id, CAST(coalesce(CASE WHEN label % 3 = 0 THEN NULL ELSE label END, (SELECT quantile_cont(label, 0.5) FROM embeddings WHERE label % 3 <> 0)) AS DOUBLE) AS filled FROM embeddings", frames=False)
def median_fill(b: Base) -> DataFrame:
    rows = b.table("embeddings").select("vec_id", F.when(F.col("label") % 3 != 0, F.col("label").cast("double")).alias("x"))
    return rows.crossJoin(F.broadcast(stats.quantiles(rows, {"m": ("x", 0.5)}))).select("vec_id", F.coalesce("x", "m").alias("filled"))


@query("p03_scrub", "SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN -1e30 ELSE round(x, 6) END AS x FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 1 THEN 'inf'::DOUBLE WHEN event_id % 7 = 2 THEN NULL ELSE value END AS x FROM events)", frames=False)
def scrub(b: Base) -> DataFrame:
    k = F.col("event_id") % 7
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k > 2, F.col("value"))
    return b.table("events").select("event_id", ranking.sane(r6(x)).alias("x"))


@query("p08_degree_buckets", "SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 40 THEN '21-40' ELSE '41+' END AS bucket, count(*) AS users FROM (SELECT u, count(*) AS n FROM inter GROUP BY u) GROUP BY 1")
def degree_buckets(b: Base) -> DataFrame:
    n = F.col("n")
    users = b.interactions().groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return users.groupBy(F.when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 40, "21-40").otherwise("41+").alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query("p09_quantile_buckets", ", e AS (SELECT quantile_cont(hours, 0.25) AS a, quantile_cont(hours, 0.5) AS b, quantile_cont(hours, 0.75) AS c FROM inter) SELECT CAST((hours >= a)::INT + (hours >= b)::INT + (hours >= c)::INT AS INT) AS bucket, count(*) AS n, round(avg(hours_t), 6) AS mean FROM inter CROSS JOIN e GROUP BY 1")
def quantile_buckets(b: Base) -> DataFrame:
    rows = b.stored()
    edges = stats.quantiles(rows, {f"e{k}": ("hours", p) for k, p in enumerate((0.25, 0.5, 0.75))})
    bucket = sum((F.col("hours") >= F.col(f"e{k}")).cast("int") for k in range(3))
    return rows.crossJoin(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hours_t")).alias("mean"))


@query("p10_family_regex", "SELECT regexp_replace(regexp_replace(lower(p_type), '\\s+', '_', 'g'), '_(tin|steel|brass|copper|nickel)$', '') AS family, count(*) AS n FROM part GROUP BY 1", frames=False)
def family_regex(b: Base) -> DataFrame:
    return b.table("part").groupBy(T.family("p_type").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("w11_lag_same_user", "SELECT event_id, user_id, lag(event_id) OVER w AS prev_id, date_diff('second', lag(date_trunc('second', ts)) OVER w, date_trunc('second', ts)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", frames=False)
def lag_same_user(b: Base) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    return b.table("events").select("event_id", "user_id", F.lag("event_id").over(w).alias("prev_id"), (second - F.lag(second).over(w)).alias("gap"))


@query("w14_quantile_bins", ", p AS (SELECT i, count(*) AS pop FROM inter GROUP BY i), r AS (SELECT i, pop, row_number() OVER (ORDER BY pop, i) AS r, count(*) OVER () AS n FROM p) SELECT i, pop, CAST(greatest(0, ceil(10 * (r - 1) / (n - 1)) - 1) AS INT) AS bin FROM r")
def quantile_bins(b: Base) -> DataFrame:
    return ranking.binned_counts(b.interactions().groupBy("i").agg(F.count(F.lit(1)).alias("pop")), "pop", 10).select("i", "pop", "bin")


@query("f02_recency_weight", "SELECT u, round(sum(pow(0.5, date_diff('day', d, (SELECT max(d) FROM inter)) / 365.0)), 6) AS w FROM inter GROUP BY u")
def recency_weight(b: Base) -> DataFrame:
    rows = b.interactions()
    return T.with_recency(rows, "d", 365.0).groupBy("u").agg(r6(F.sum("recency")).alias("w"))


@query("f03_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_no FROM orders", frames=False)
def date_parts(b: Base) -> DataFrame:
    d = F.to_date("o_orderdate")
    return b.table("orders").select("o_orderkey", F.year(d).alias("y"), F.date_format(d, "yyyy-MM").alias("ym"), F.unix_date(d).alias("day"), (F.year(d) * 12 + F.month(d)).alias("month_no"))


@query("f05_clean_text", "SELECT doc_id, length(c) AS n, c AS cleaned FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS c FROM documents)", frames=False)
def clean_text(b: Base) -> DataFrame:
    rows = b.table("documents").select("doc_id", T.collapsed("text").alias("cleaned"))
    return rows.select("doc_id", F.char_length("cleaned").cast("long").alias("n"), "cleaned")


@query("f05_whole_clean_text", "SELECT doc_id, length(c) AS n, sha256(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS c FROM documents)", frames=False)
def whole_clean_text(b: Base) -> DataFrame:
    """The digest is that of the whole cleaned text."""
    rows = b.table("documents").select("doc_id", T.collapsed("text").alias("c"))
    return rows.select("doc_id", F.char_length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest"))


STOP = "', '".join(T.STOP_WORDS)


@query("f06_token_counts", f"SELECT source, w AS token, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}')) AS w FROM documents) WHERE w NOT IN ('{STOP}') GROUP BY 1, 2", frames=False)
def token_counts(b: Base) -> DataFrame:
    return T.token_counts(b.table("documents"), "source", "text")


@query("f07_text_digest", "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || ':' || text || chr(10)) AS digest FROM documents", frames=False)
def text_digest(b: Base) -> DataFrame:
    return b.table("documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text", F.lit("\n")), 256).alias("digest"))


@query("f09_json_counts", "SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2", frames=False)
def json_counts(b: Base) -> DataFrame:
    return b.table("events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "k")).where("key = 'k'").groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("f10_safe_cast", "SELECT c_custkey, TRY_CAST(nullif(nullif(v, 'nan'), '') AS DOUBLE) AS v, TRY_CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS first_number FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'nan' WHEN c_custkey % 4 = 1 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS v FROM customer)", frames=False)
def safe_cast(b: Base) -> DataFrame:
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, "nan").when(k == 1, "x").otherwise(F.col("c_nationkey").cast("string"))
    return b.table("customer").select("c_custkey", T.number(v).alias("v"), T.first_number("c_name").alias("first_number"))
