"""Learned queries: what no SQL gives is held to its properties."""

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cand(spark):
    return {r.id: r for r in entry.queries()["n08_split_candidates"](spark, DATA).collect()}


def rows(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def test_als_and_hybrids_score_every_candidate(spark, cand):
    plain = {r.id: r.score for r in rows(spark, "m24_als")}
    assert set(plain) == set(cand) and len(set(plain.values())) > 100
    for r in rows(spark, "m24_als_hybrids"):
        assert r.events == pytest.approx(plain[r.id], abs=1e-4) and 0 <= r.events_pop10 - r.events <= 0.1 + 1e-9


@pytest.mark.parametrize("name", ["m32_logistic_ranker", "m32_gbt_ranker"])
def test_rankers_choose_half_of_each_user(spark, cand, name):
    by_user = {}
    for r in rows(spark, name):
        assert 0 <= r.score <= 1
        by_user.setdefault(cand[r.id].u, []).append(r.pred)
    assert sum(map(len, by_user.values())) == len(cand) and all(sum(p) == len(p) // 2 for p in by_user.values())


def test_communities_and_their_negatives(spark, cand):
    groups = {r.u: r.community for r in rows(spark, "m18_communities")}
    assert 1 < len(set(groups.values())) <= 12 and {r.u for r in cand.values()} <= set(groups)
    for r in rows(spark, "m18_community_scores"):
        assert 0 <= r.rate <= 1 and r.blend >= r.log_pop >= 0
    seen = {(r.u, r.i) for r in cand.values() if r.label}
    wanted = {}
    for u, _ in seen:
        wanted[u] = wanted.get(u, 0) + 1
    found = [(r.u, r.i) for r in rows(spark, "n06_community_negatives")]
    assert len(set(found)) == len(found) and not set(found) & seen
    assert {u: sum(v == u for v, _ in found) for u in wanted} == wanted


def test_categories_cover_documents(spark):
    found = rows(spark, "m19_pseudo_categories")
    assert len({r.doc_id for r in found}) == spark.read.parquet(f"{DATA}/documents.parquet").count() and len({r.category for r in found}) > 1


def test_intervals_and_cross_fits(spark):
    r = rows(spark, "n12_user_bootstrap")[0]
    assert 0 <= r.low <= r.mean <= r.high <= 1
    assert sorted(x.fold for x in rows(spark, "e10_crossfit_lambda")) == [0, 1]
    for x in rows(spark, "e04_exact_binomial"):
        assert 0 <= x.p <= 1 and 0 <= x.p_mcnemar <= 1
