"""A fast selection of the registered queries against their SQL text (tools/compare.py runs them all)."""

import duckdb
import pytest

from pulsegrid.plans import catalog
from tools.compare import TABLES, canon

SF = "/root/testdata/sf0.001"
NAMES = ("window_labels", "window_peaks", "asof_nearest", "asof_backward", "interval_join", "archetype_label", "label_family", "clean_numeric", "group_summary",
         "baseline_relative", "softmax_pref", "metric_auc", "metric_ap", "bh_fdr", "corr_redundancy", "group_kfold", "even_spaced_sample", "autocorr",
         "spectral_features", "wavelet_energy", "cross_corr_lag", "resample_linear", "session_gap_split", "stream_gap_sessions", "ewma_filter",
         "stream_ordered_signal", "top_redundancy", "subject_logit")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got).equals(canon(want))


def test_every_query_has_a_builder_and_most_have_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.ORACLES) >= 0.85 * len(catalog.QUERIES)
