"""Small cases whose answers can be worked out by hand."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import evaluation, fusion, graph, ranking, resampling, similarity, split, stats
from rankloom.sources import io


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("scores", "want"), [([5.0, 5.0, 5.0, 1.0], [1, 1, 0, 0]), ([float("nan"), float("inf"), 2.0, 1.0], [0, 0, 1, 1])])
def test_decode_breaks_ties_by_id_and_puts_odd_scores_last(spark, scores, want):
    df = spark.createDataFrame([(k + 1, 1, s) for k, s in enumerate(scores)], "id long, u long, s double")
    assert [r.pred for r in ranking.top_half(df, "s").orderBy("id").collect()] == want


def test_decode_by_labels(spark):
    df = spark.createDataFrame([(1, 1, 0.1, 1), (2, 1, 0.9, 0), (3, 1, 0.5, 0)], "id long, u long, s double, label int")
    assert sum(r.pred for r in ranking.top_half(df, "s", "label").collect()) == 1
    with pytest.raises(ValueError):
        ranking.top_half(df, "s", "most")


def test_decode_ignores_monotone_transforms(spark):
    df = spark.createDataFrame([(k, k % 3, math.sin(k)) for k in range(30)], "id long, u long, s double").withColumn("t", F.exp("s") * 7)
    a, b = ({r.id: r.pred for r in ranking.top_half(df, s).collect()} for s in ("s", "t"))
    assert a == b


def test_average_rank_and_z_of_a_lone_row(spark):
    df = spark.createDataFrame([(k, 1, s) for k, s in enumerate([3.0, 1.0, 1.0, 2.0])] + [(9, 2, 4.0)], "id long, u long, s double")
    rows = {r.id: r for r in df.select("id", (ranking.average_rank("s") / F.count(F.lit(1)).over(ranking.by_user())).alias("p"), ranking.z("s").alias("z"), ranking.z("s", mode="samp_unit").alias("y")).collect()}
    assert [rows[k].p for k in range(4)] == [1.0, 0.375, 0.375, 0.75] and rows[9].z == 0 and rows[9].y == 0


def test_margin_is_null_without_a_boundary(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 3.0), (3, 2, 1.0)], "id long, u long, s double")
    assert {r.u: r.margin for r in ranking.with_boundary(df, "s").collect()} == {1: 2.0, 2: None}


@pytest.mark.parametrize("n", [1, 7, 11, 57])
def test_quantile_bins_of_ranks(spark, n):
    df = spark.createDataFrame([(k, k // 2) for k in range(n)], "i long, v long")
    want = [max(0, math.ceil(10 * r / (n - 1)) - 1) if n > 1 else 0 for r in range(n)]
    assert [r.bin for r in ranking.binned_counts(df, "v", 10).orderBy("i").collect()] == want
    assert [r.b for r in df.select("i", ranking.quantile_bin([F.col("v"), F.col("i")], 10).alias("b")).orderBy("i").collect()] == want


def test_statistics(spark):
    df = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert one(stats.gini(df([1, 1, 1, 1]), "x")) == 0 and one(stats.gini(df([0, 0, 0, 1]), "x")) == 0.75
    assert one(stats.ks(spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "x int, a boolean"), "x", F.col("a"))) == 1.0
    assert one(stats.auc(spark.createDataFrame([(1.0, 0), (1.0, 1)], "s double, label int"), "s")) == 0.5
    assert stats.percentiles(df([1, 2, 4]), "x", (0.05,)).first().p05 == pytest.approx(1.1)
    assert one(df([2, 2, 2]).agg(stats.correlation("x", "x"))) is None


def test_tests_of_significance():
    assert stats.binomial_two_sided(1, 9) == pytest.approx(0.021484375) and stats.binomial_two_sided(0, 0) == 1
    assert stats.mcnemar_p(5, 5) == 1 and stats.fisher_combined([1.0, 1.0]) == 1
    assert stats.chi_square_survival(2.0, 1) == pytest.approx(math.exp(-1))


def test_chances_as_columns(spark):
    pairs = [(0, 0), (1, 9), (5, 5), (0, 7), (900, 1100), (33, 61), (2, 400), (49_000, 51_000), (30_000, 31_000)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", stats.binomial_p(F.col("a"), F.col("b")).alias("p"), stats.mcnemar_chance(F.col("a"), F.col("b")).alias("m"))
    for r in rows.collect():
        assert r.p == pytest.approx(stats.binomial_two_sided(r.a, r.b), rel=1e-7) and r.m == pytest.approx(stats.mcnemar_p(r.a, r.b), rel=1e-9, abs=1e-15)
    x = spark.createDataFrame([(k / 8,) for k in range(48)], "x double")
    for r in x.select("x", stats.normal_tails(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-9)
    g = spark.createDataFrame([(k / 4,) for k in range(4, 200)], "x double")
    for r in g.select("x", stats.log_gamma(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)


def test_fisher_combines_any_number_of_tests(spark):
    groups = {"one": [0.03], "some": [0.2, 0.7, 0.01], "sure": [1.0, 1.0], "none": [None], "many": [0.5] * 3000, "zero": [0.0, 0.5]}
    rows = spark.createDataFrame([(k, p) for k, ps in groups.items() for p in ps], "k string, p double")
    found = {r.k: r for r in stats.fisher(rows, "p", ("k",)).collect()}
    for k in ("one", "some", "sure", "zero"):
        assert found[k].combined == pytest.approx(stats.fisher_combined(groups[k]), rel=1e-9, abs=1e-300)
    assert found["none"].tests == 0 and found["none"].combined == 1 and 0.9999 < found["many"].combined <= 1
    assert found["one"].combined == pytest.approx(0.03)
    assert stats.fisher(rows.limit(0), "p").first().combined == 1


def test_candidates_and_score_files(spark, tmp_path):
    rows = spark.createDataFrame([(7, "u1", "g1", 0.5, "x"), (8, "u2", "g2", None, "y")], "ID long, userID string, gameID string, score_a double, note string")
    path = str(tmp_path / "scores.csv")
    rows.write.option("header", True).csv(path)
    read = io.candidates(spark, path)
    assert dict(read.dtypes)["ID"] == "int" and sorted(r.gameID for r in read.collect()) == ["g1", "g2"]
    assert io.scores(read, prefix="new_").columns == ["ID", "userID", "gameID", "new_score_a"]
    rows.drop("gameID").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="gameID"):
        io.candidates(spark, str(tmp_path / "short"))
    dated = spark.createDataFrame([("2015-01-02", 1), ("soon", 2)], "date string, n int")
    dated.write.option("header", True).csv(str(tmp_path / "dated.csv"))
    read = io.read_table(spark, str(tmp_path / "dated.csv"), "date string, n int")
    assert sorted((r.n, r.date is None) for r in read.collect()) == [(1, False), (2, True)]


def test_negative_weights_from_a_histogram_equal_those_of_rows(spark):
    data = [(k % 7 / 2, k % 2, k % 3 % 2) for k in range(200)]
    rows = spark.createDataFrame(data, "s double, label int, pred int")
    neg = [(s, p) for s, y, p in data if y == 0]
    mean = sum(s for s, _ in neg) / len(neg)
    sd = (sum((s - mean) ** 2 for s, _ in neg) / len(neg)) ** 0.5
    for r in fusion.negative_weights(rows, "s", [-1.0, 0.0, 2.5]).collect():
        w = [(math.exp(r.beta * (s - mean) / sd), p == 0) for s, p in neg]
        assert r.right == pytest.approx(sum(x for x, ok in w if ok) / sum(x for x, _ in w))


def test_mcnemar_is_clipped(spark):
    df = spark.createDataFrame([(5, 5), (8, 2), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(evaluation.mcnemar(F.col("a"), F.col("b"))).collect()] == [0.0, 2.5, None]


def test_reciprocal_ranks(spark):
    assert one(spark.createDataFrame([(1, 3)], "a int, b int").select(fusion.reciprocal_rank(["a", "b"], 60))) == pytest.approx(1 / 61 + 1 / 63)


def test_bm25_clips_and_tfidf_changes_no_cosine(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (1, 2), (2, 3)], "u long, i long")
    assert {r.w for r in similarity.bm25(rows).where("i = 1").collect()} == {0.0}
    plain = {(r.i, r.j): r.sim for r in similarity.cosine(rows).collect()}
    weighed = similarity.cosine(rows.join(similarity.tf_idf(rows), "i"), "w").collect()
    assert all(r.sim == pytest.approx(plain[r.i, r.j]) for r in weighed) and len(weighed) == len(plain)


def test_missing_similarities_count_as_zero(spark):
    cand = spark.createDataFrame([(1, 1, 5)], "id long, u long, i long")
    hist = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 5, 1.0), (2, 1, 1.0)], "u long, i long, hours double")
    pairs = spark.createDataFrame([(1, 5, 0.8)], "i long, j long, s double")
    assert sorted((r.sim, r.hours) for r in similarity.history_similarities(cand, hist, pairs, "hours").collect()) == [(0.0, 4.0), (0.8, 2.0)]
    r = similarity.item_knn(cand, hist).first()
    # Items 5 and 1 share one user of one and of two: 1 / sqrt(2).
    assert (r.knn_sum, r.knn_max, r.knn_top3) == pytest.approx((0.5**0.5, 0.5**0.5, 0.5**0.5 / 2)) and r.knn_hours == pytest.approx(2 * 0.5**0.5 / 6, rel=1e-5)


def test_neighbours_repeat_their_last_item(spark):
    sims = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], "i long, j long, sim double")
    assert [(r.r, r.j) for r in similarity.neighbours(sims, 4).orderBy("r").collect()] == [(1, 2), (2, 3), (3, 3), (4, 3)]


def test_a_user_has_one_swap(spark):
    swaps = spark.createDataFrame([(1, 11, 12, 0.5), (1, 13, 14, 0.4), (2, 21, 22, 0.1)], "u long, up_id long, down_id long, gain double")
    assert [(r.u, r.up_id) for r in fusion.budgeted(swaps, "gain", 5).collect()] == [(1, 11), (2, 21)]


def test_split_has_no_leak(spark):
    inter = spark.createDataFrame([(u, i) for u in range(5) for i in range(u, u + 20)], "u long, i long")
    items = spark.createDataFrame([(i,) for i in range(200)], "i long")
    sizes = split.hold_out_sizes(inter)
    held, neg = split.hold_out(inter), split.proposed_negatives(sizes, split.in_places(items), inter, "n:")
    checks = split.checks(inter.join(held, ["u", "i"], "left_anti"), split.candidates(held, neg)).first()
    assert (checks.n_rows, checks.positives, checks.ids, checks.overlap, checks.uneven_users, checks.cold_users) == (20, 10, 20, 0, 0, 0)


def test_every_user_gets_all_negatives(spark):
    items = spark.createDataFrame([(1000 * i,) for i in range(100)], "i long")
    seen = {1: 95, 2: 97, 3: 10, 4: 100}
    inter = spark.createDataFrame([(u, 1000 * i) for u, n in seen.items() for i in range(n)], "u long, i long")
    sizes = spark.createDataFrame([(u, 5) for u in seen], "u long, k long")
    rows = [(r.u, r.i) for r in split.whole_negatives(sizes, items, inter, "n:").collect()]
    assert len(rows) == len(set(rows)) and not any(i < 1000 * seen[u] for u, i in rows)
    assert Counter(u for u, _ in rows) == {1: 5, 2: 3, 3: 5}
    dense = spark.createDataFrame([(i,) for i in range(200)], "i long")
    plain, whole = (sorted(map(tuple, x.collect())) for x in (split.proposed_negatives(sizes, split.in_places(dense), inter, "n:"), split.whole_negatives(sizes, dense, inter, "n:")))
    assert plain == whole and len(whole) == 20


def test_sparse_item_numbers_need_no_list_of_all_items(spark):
    """Items numbered a million apart: the first round of draws is enough for nearly all, and no user lists all items."""
    items = spark.range(500).select((F.col("id") * 1_000_000).alias("i"))
    inter = spark.range(300).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).select("u", ((F.col("u") + F.col("k")) % 500 * 1_000_000).alias("i"))
    sizes = spark.range(300).select(F.col("id").alias("u"), F.lit(5).cast("long").alias("k"))
    first = split.proposed_negatives(sizes, split.in_places(items), inter, "n:").groupBy("u").count().where("count = 5").count()
    assert first == 300
    pairs = inter.select("u", "i")
    assert split.triplets(pairs, items, inter, "t:").join(inter.withColumnRenamed("i", "neg"), ["u", "neg"], "left_semi").count() == 0
    assert split.triplets(pairs, items, inter, "t:").count() == pairs.count()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")
    assert dict(graph.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_component_sizes_of_all_interactions(spark):
    import __spark_entry__ as entry
    from rankloom.plans.base import Base

    labels = graph.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 6)], "a long, b long"))
    assert {(r["size"], r.n) for r in graph.component_sizes(labels).collect()} == {(4, 1), (2, 2)}
    data, above = "/root/testdata/sf0.001", {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for r in Base(spark, data).interactions().select("u", "i").collect():
        above[top(("u", r.u))] = top(("i", r.i))
    sizes = Counter(Counter(map(top, list(above))).values())
    rows = entry.queries()["a21_component_sizes"](spark, data).collect()
    assert {r["size"]: r.n for r in rows} == sizes
    assert {(r.components, r.largest, r.largest_share) for r in rows} == {(sum(sizes.values()), max(sizes), round(max(sizes) / len(above), 6))}


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([(k, k // 4, k % 2, int(k % 3 == 0)) for k in range(400)], "id long, u long, label int, pred int")
    r = resampling.user_bootstrap(rows, 100).first()
    true = sum((k % 2) == int(k % 3 == 0) for k in range(400)) / 400
    assert r.low <= true <= r.high and r.mean == pytest.approx(true, abs=0.03)


def test_literal_logs(spark, tmp_path):
    lines = ["{'userID': 'u1', 'gameID': 'g', 'early_access': False, 'text': \"it's ok: True\", 'hours': 3, 'date': '2015-01-02'}", "", "not a dict {"]
    (tmp_path / "log.json").write_text("\n".join(lines))
    rows = io.literal_logs(spark, str(tmp_path / "log.json")).collect()
    good = next(r for r in rows if r.userID)
    assert len(rows) == 2 and good.early_access is False and good.text == "it's ok: True" and good.hours == 3.0 and not good.has_found_funny
    assert next(r for r in rows if not r.userID)._corrupt == "not a dict {"


def test_submission_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (0, 1)], "ID int, Label int")
    io.write_submission(df, str(tmp_path / "s.csv"))
    assert sorted(map(tuple, io.label_file(io.read_table(spark, str(tmp_path / "s.csv"))).collect())) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        io.label_file(df.drop("Label"))


def test_ensemble_and_scores(spark):
    files = [spark.createDataFrame([(1, "u", "g", x)], "ID int, userID string, gameID string, score_a double") for x in (1.0, 3.0)]
    assert io.scores(files[0], prefix="m_").columns == ["ID", "userID", "gameID", "m_score_a"]
    r = io.ensemble(files, "score_a").first()
    assert (r["mean"], r.sd, r.n) == (2.0, 1.0, 2)


def test_text_functions(spark):
    df = spark.createDataFrame([("the quick brown fox",)], "t string")
    assert one(df.select(T.cut_at_word(F.col("t"), 12))) == "the quick" and one(df.select(T.number(F.lit(" None ")))) is None


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from rankloom.streaming.popularity import windowed_counts

    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = windowed_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def long_matrix(spark, seed=3, users=40, items=30, per=8):
    import random

    r = random.Random(seed)
    pairs = [(u, i * 3 + 1) for u in range(users) for i in r.sample(range(items), per)]
    return pairs, spark.createDataFrame(pairs, "u long, i long")


def dense(pairs):
    import numpy as np

    us, its = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    m = np.zeros((len(us), len(its)))
    for u, i in pairs:
        m[us.index(u), its.index(i)] = 1
    return m, us, its


def test_truncated_svd_and_low_pass_match_numpy(spark):
    import numpy as np

    from rankloom.operators import factors

    pairs, rows = long_matrix(spark)
    m, us, its = dense(pairs)
    cand = spark.createDataFrame([(k, us[k % 7], its[k % 11]) for k in range(30)] + [(99, 1000, 1)], "id long, u long, i long")
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    want = (u[:, :5] * s[:5]) @ vt[:5]
    got = {r.id: r.s for r in factors.svd_scores(cand, rows.withColumn("w", F.lit(1.0)), 5).collect()}
    assert all(abs(got[k] - want[us.index(us[k % 7]), its.index(its[k % 11])]) < 1e-6 for k in range(30)) and got[99] == 0
    du, di = m.sum(1), m.sum(0)
    n = m / np.sqrt(du)[:, None] / np.sqrt(di)[None, :]
    v = np.linalg.svd(n, full_matrices=False)[2][:5].T
    ideal = m @ ((v @ v.T) / np.sqrt(di)[:, None] * np.sqrt(di)[None, :])
    linear = m @ (n.T @ n)
    rows = {r.id: r for r in factors.low_pass(cand, rows, 5, 0.3).collect()}
    for k in range(30):
        a, b = us.index(us[k % 7]), its.index(its[k % 11])
        assert abs(rows[k]["pass"] - ideal[a, b]) < 1e-6 and abs(rows[k].linear - linear[a, b]) < 1e-9
        assert abs(rows[k].both - linear[a, b] - 0.3 * ideal[a, b]) < 1e-6


def test_community_scores(spark):
    from rankloom.operators import factors

    rows = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 30)], "u long, i long")
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "u long, community int")
    cand = spark.createDataFrame([(1, 1, 10), (2, 3, 10), (3, 9, 30)], "id long, u long, i long")
    found = {r.id: r for r in factors.community_scores(cand, rows, members).collect()}
    assert found[1].log_pop == pytest.approx(math.log(3)) and found[1].rate == pytest.approx(2 / 3) and found[1].blend == pytest.approx(1.25 * math.log(3))
    assert found[2].rate == 0 and found[3].log_pop == 0


def test_user_pairs_in_blocks_are_the_same_pairs(spark):
    pairs, rows = long_matrix(spark, per=12)
    want = Counter()
    for u in {u for u, _ in pairs}:
        own = sorted(i for v, i in pairs if v == u)
        want.update((a, b) for x, a in enumerate(own) for b in own[x + 1 :])
    for tile in (3, 5, 1024):
        assert Counter((r.i, r.j) for r in similarity.user_pairs(rows, tile=tile).collect()) == want


def test_user_knn_matches_all_pairs(spark):
    pairs, rows = long_matrix(spark)
    m, us, its = dense(pairs)
    cand = [(k, us[k % 13], its[(k * 7) % 29]) for k in range(40)]
    got = {r.id: r for r in similarity.user_knn(spark.createDataFrame(cand, "id long, u long, i long"), rows).collect()}
    own = [set(i for v, i in pairs if v == u) for u in us]
    for k, u, i in cand:
        sims = [len(own[us.index(u)] & own[us.index(v)]) / math.sqrt(len(own[us.index(u)]) * len(own[us.index(v)])) for v in us if v != u and i in own[us.index(v)]]
        # What a candidate shares with its user through the candidate itself doesn't count: it is not in the history.
        if i not in own[us.index(u)]:
            assert got[k].uknn_sum == pytest.approx(sum(sims)) and got[k].uknn_max == pytest.approx(max(sims)) and got[k].uknn_norm == pytest.approx(sum(sims) / math.sqrt(len(sims) + 1))


def test_prefix_sums_and_quantiles_over_ranges(spark):
    import random
    import statistics

    r = random.Random(4)
    values = [r.choice([None, r.random(), r.randint(0, 5) * 1.0]) for _ in range(500)]
    df = spark.createDataFrame([(v, k % 2) for k, v in enumerate(values)], "x double, g int")
    known = sorted(v for v in values if v is not None)
    found = stats.quantiles(df, {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("x", 0.975)}).first()

    def at(p):
        k = (len(known) - 1) * p
        low = known[math.floor(k)]
        return low + (known[math.ceil(k)] - low) * (k - math.floor(k))

    assert (found.a, found.b, found.c) == pytest.approx((at(0.25), statistics.median(known), at(0.975)))
    hist = df.where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    rows = stats.prefix_sums(hist, "x", ["c"], ("g",), descending=True).collect()
    for row in rows:
        assert row.c_before == sum(q.c for q in rows if q.g == row.g and q.x > row.x)


def sampled(spark, users=30, items=60, have=20):
    import random

    r = random.Random(7)
    seen = [(u, i) for u in range(users) for i in r.sample(range(items), have if u else items - 2)]
    sizes = [(u, 4 if u else 5) for u in range(users)]
    return seen, spark.createDataFrame(seen, "u long, i long"), spark.createDataFrame(sizes, "u long, k long")


def test_weighted_negatives_reach_every_user_and_follow_weights(spark):
    seen, seen_df, sizes = sampled(spark)
    items = spark.createDataFrame([(i, i * i) for i in range(60)], "i long, w long")
    got = [(r.u, r.i) for r in split.weighted_negatives(sizes, items, seen_df, "t:").collect()]
    count = Counter(u for u, _ in got)
    # The user who has seen all but two gets these two; the others their four.
    assert len(set(got)) == len(got) and not set(got) & set(seen) and count[0] == 2 and all(count[u] == 4 for u in range(1, 30))
    assert sum(i for u, i in got if u) / sum(1 for u, _ in got if u) > 38
    assert split.weighted_negatives(sizes.where("u < 0"), items, seen_df, "t:").count() == 0


def test_binned_negatives_fill_up_from_other_bins(spark):
    _, seen_df, _ = sampled(spark)
    seen = {(r.u, r.i) for r in seen_df.collect()}
    items = spark.createDataFrame([(i, int(i >= 58), 5) for i in range(60)], "i long, bin int, w long")
    wanted = spark.createDataFrame([(u, b, 2) for u in range(1, 30) for b in (0, 1)], "u long, bin int, k long")
    got = split.binned_negatives(wanted, items, seen_df, "b:").collect()
    assert Counter(r.u for r in got) == dict.fromkeys(range(1, 30), 4)
    assert not {(r.u, r.i) for r in got} & seen and len({(r.u, r.i) for r in got}) == len(got)
    assert any(not r.in_bin for r in got)  # bin 1 has two items, which many users have seen


def test_community_negatives_and_triplets_are_unseen(spark):
    seen_list, seen_df, _ = sampled(spark)
    items = spark.createDataFrame([(c, b, i, 1 + i * c) for c in (0, 1) for b in (0, 1) for i in range(60) if abs(i // 30 - b) <= 1], "community int, bin int, i long, w long")
    wanted = spark.createDataFrame([(u, u % 2, b, 2) for u in range(1, 30) for b in (0, 1)], "u long, community int, bin int, k long")
    got = [(r.u, r.i) for r in split.community_negatives(wanted, items, seen_df, "c:").collect()]
    assert len(set(got)) == len(got) and not set(got) & set(seen_list) and Counter(u for u, _ in got) == dict.fromkeys(range(1, 30), 4)
    pairs = seen_df.where("u > 0")
    found = split.triplets(pairs, items.select("i").distinct(), seen_df, "bpr:").collect()
    assert len(found) == pairs.count() and not {(r.u, r.neg) for r in found} & set(seen_list)


def test_propagation_of_vectors(spark):
    import numpy as np

    pairs, rows = long_matrix(spark)
    m, us, its = dense(pairs)
    r = np.random.default_rng(2)
    x, y = r.normal(size=(len(us), 3)), r.normal(size=(len(its), 3))
    users = spark.createDataFrame([(u, x[k].tolist()) for k, u in enumerate(us)], "u long, v array<double>")
    items = spark.createDataFrame([(i, y[k].tolist()) for k, i in enumerate(its)], "i long, v array<double>")
    a = m / np.sqrt(m.sum(1))[:, None] / np.sqrt(m.sum(0))[None, :]
    want = [(x + a @ y + a @ (a.T @ x)) / 3, (y + a.T @ x + a.T @ (a @ y)) / 3]
    got = graph.propagated(rows, users, items, 3, 2)
    assert np.allclose([v for _, v in sorted((r.u, r.v) for r in got[0].collect())], want[0])
    assert np.allclose([v for _, v in sorted((r.i, r.v) for r in got[1].collect())], want[1])
    mean = 0.6 * x + 0.4 * (m / m.sum(1)[:, None]) @ y
    got = graph.aggregated(rows, users, items, 3, 0.4)[0].collect()
    assert np.allclose([v for _, v in sorted((r.u, r.v) for r in got)], mean / np.linalg.norm(mean, axis=1)[:, None])


def test_ensembles_want_every_key_in_every_file(spark):
    a, b = (spark.createDataFrame(x, "ID long, s double") for x in ([(1, 1.0), (2, 2.0)], [(1, 3.0)]))
    assert {r.ID: (r.mean, r.n) for r in io.ensemble([a, b], "s", strict=False).collect()} == {1: (2.0, 2), 2: (2.0, 1)}
    with pytest.raises(Exception, match="not once in every file"):
        io.ensemble([a, b], "s").collect()


def test_columns_label_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.1, "a|b"), (2, None, 0.2, None)], "ID long, score_a double, score_b double, note string")
    assert io.score_columns(df, include="a|b", exclude="b$") == ["score_a"] and io.score_columns(df, wanted=["ID"]) == ["ID"]
    with pytest.raises(ValueError):
        io.score_columns(df, wanted=["nothing"])
    checks = lambda rows: io.label_checks(spark.createDataFrame(rows, "ID long, Label string")).first().asDict()
    assert checks([(0, "1"), (1, "0"), (2, "1")]) == {"n_rows": 3, "ids": 3, "lo": 0, "hi": 2, "not_binary": 0, "contiguous": 1}
    assert checks([(0, "1"), (0, "2"), (5, "x")]) == {"n_rows": 3, "ids": 2, "lo": 0, "hi": 5, "not_binary": 2, "contiguous": 0}
    assert [r.line for r in io.markdown(df.orderBy("ID")).collect()] == ["| 1 | 0.5 | 0.1 | a\\|b |", "| 2 |  | 0.2 |  |"]
    io.write_markdown(df, str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()][:2] == ["| ID | score_a | score_b | note |", "| --- | --- | --- | --- |"]
    io.write_jsonl(df, str(tmp_path / "jl"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "jl")).collect())[1] == '{"ID":2,"score_a":null,"score_b":0.2,"note":null}'


def test_bootstraps_and_exact_binomial(spark):
    rows = spark.createDataFrame([(k, k % 40, (k // 3) % 2, (k // 3) % 2 if k % 4 else 1 - (k // 3) % 2, (k // 3) % 2) for k in range(400)], "id long, u long, label int, pred int, other int")
    pair = resampling.paired_bootstrap(rows, "pred", "other", 100).first()
    assert 0.05 < pair.low < pair.mean < pair.high < 0.5 and abs(pair.mean - 0.25) < 0.05 and 0 < pair.error < 0.1
    auc = resampling.auc_bootstrap(rows.select("id", F.col("pred").cast("double").alias("score"), "label"), 50).first()
    assert auc.low <= auc.mean <= auc.high and abs(auc.mean - 0.75) < 0.05
    assert stats.binomial_two_sided(1, 3) == 0.625 and stats.binomial_two_sided(0, 0) == 1.0 and 0 < stats.binomial_two_sided(900, 1100) < 1e-4
