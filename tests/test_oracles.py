"""Registered queries against their DuckDB twins (the driver's correctness gate, in small)."""
import pytest

from qualm.plans.oracle import compare, duckdb_connect
from tests.conftest import SMALL

import __spark_entry__ as E

FAST = ["b8_eval_set", "b9_filter_dimensionality", "b12_nan_guard", "g1_safe_corr", "g3_spearman",
        "g4_kl_divergence", "g5_r2_score", "g6_stats_1d", "j1_grid_pearson_bertscore", "j2_baseline_means",
        "h1_calib_split", "h8_scheme_evaluation", "f1_knn_uncertainty", "flagship_knn_selective",
        "b1_to_text", "b4_normalize_record", "d2_mean_pooling", "d5_standard_scaler", "d6_pca", "d7_svd", "d8_tucker", "d10_mahalanobis_filter", "d10_mahalanobis_vectors", "f2_kmeans_knn_lloyd", "f3_kmeans_uq_no_knn", "f6_kde_bandwidth", "f8_kmeans_kde_frames",
        "e2_merge_small_clusters", "e4_core_distance", "f7_kde_fixed_bandwidth", "i1_decode_configs",
        "i7_nondominated", "i8_hypervolume", "i10_early_stop", "i13_cumulative_front", "i15_progress_summary",
        "i18_rvea_selection", "a1_read_delimited_dir", "a6_progress_roundtrip", "i19_eval_log_analysis",
        "a2_load_random", "a3_read_results", "d11_float32_cast", "b11_baseline_tables", "h5_risk_coverage", "c1_rouge_l", "d1_embed_default"]


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SMALL)


def test_every_query_has_a_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    r = compare(df, E.oracle_sql()[name], SMALL, con)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["values_match"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert {"auroc", "aurc", "acc_at_80"} <= set(df.columns)
