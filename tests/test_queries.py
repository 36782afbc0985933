"""Registered queries against their SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: One or two of each kind by default; all of them with RANKLOOM_ALL_QUERIES=1.
NAMES = ["n08_split_checks", "n04_sqrtpop_negatives", "n05_popbin_negatives", "n09_bpr_triplets", "n12_auc_interval", "a02_user_stats", "a06_percentile_summary", "a08_popularity_cover_labels", "a10_gini", "a11_ks_two_sample", "a13_rank_auc", "a19_group_documents", "a21_components", "w08_tophalf_decode", "w10_boundary_margin", "w14_quantile_bins", "w16_gated_band", "e01_evaluate_tophalf", "e04_exact_binomial", "e06_fisher_combined", "b06_lcb_ucb", "b17_negative_reweight", "b10_residual_grid", "b12_promote_rules", "k01_mixed_sort", "k07_budgeted_swaps", "u01_union_all", "u04_jaccard_matrix", "f05_clean_text", "f06_token_counts", "f10_safe_cast", "m05_bm25_weight", "m07_itemknn", "m11_userknn", "m14_turbo_filter", "m16_covisitation", "m17_temporal_overlap", "m20_tfidf_profile_cosine", "m21_item_texts", "m22_tfidf", "m23_centroid_cosine", "m23_user_centroids", "m27_layer_mean_scores", "o01_quarantine", "s05_selected_texts"]
if os.environ.get("RANKLOOM_ALL_QUERIES"):
    NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(clean(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["s05_whole_texts", "f05_whole_clean_text"])
def test_whole_texts_equal_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


def test_whole_sort_keeps_every_row_in_order(spark, duck):
    df = entry.queries()["k01_whole_sort"](spark, DATA)
    found = [(r.u, r.id, round(r.s1, 6)) for r in df.collect()]
    assert found == [(u, i, round(s, 6)) for u, i, s in duck.sql(entry.oracle_sql()["k01_whole_sort"]).fetchall()]
    assert len(found) == len(duck.sql(entry.oracle_sql()["n08_split_candidates"]).fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0
