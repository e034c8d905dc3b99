import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L
from pulsegrid.functions import scoring as K
from pulsegrid.functions import text as X
from pulsegrid.operators.baseline import attach_baseline, baseline_profiles
from pulsegrid.operators.select import feature_columns


def test_label_families(spark):
    rows = [("rheumapain", 4.0, None, None), ("wesad", None, 1.0, None), ("catsa", None, None, "Baseline"), ("catsa", None, None, "stroop"),
            ("other", None, None, "Aerobic run"), ("catsa", None, None, "nback"), ("silver_pain", None, None, "rest")]
    df = spark.createDataFrame(rows, "dataset_id string, target_pain_nrs_0_10 double, target_stress_binary double, condition string")
    got = [r["label_family"] for r in L.add_common_labels(df).collect()]
    assert got == ["direct_pain", "stress_proxy", "baseline_context", "cognitive_load_proxy", "exercise_context", "unlabeled", "baseline_context"]


def test_bins_and_text(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (4.0,), (7.0,), (None,)], "x double")
    assert [r[0] for r in df.select(L.ordinal_pain_bin("x")).collect()] == [0.0, 1.0, 2.0, 3.0, None]
    t = spark.createDataFrame([(" 1,5 ",), ("nan",), ("1.0f",), ("",), ("-2e3",)], "s string")
    assert [r[0] for r in t.select(X.clean_numeric("s")).collect()] == [1.5, None, None, None, -2000.0]
    w = spark.createDataFrame([("7,5 hours",), ("Not severe",), ("çok şiddetli",), ("?",)], "s string")
    assert [r[0] for r in w.select(X.ordinal_text_score("s")).collect()] == [7.5, 0.0, 5.0, None]
    y = spark.createDataFrame([("Evet",), ("hayır",), ("0",), ("maybe",)], "s string")
    assert [r[0] for r in y.select(X.yes_no_flag("s")).collect()] == [1.0, 0.0, 0.0, None]
    p = spark.createDataFrame([("x/P12_3/P12_3.csv",)], "p string").select(*[c.alias(n) for n, c in X.clinical_session_keys("p").items()]).first()
    assert tuple(p) == ("p12", "p12_3", 3)
    with pytest.raises(Exception, match="not a clinical session path"):
        spark.createDataFrame([("x/y.csv",)], "p string").select(X.clinical_session_keys("p")["session_id"]).collect()


def test_baseline_relative_features(spark):
    rows = [("d", "s", "rest", 1.0, 0.1), ("d", "s", "Rest", 1.2, 0.2), ("d", "s", "exercise", 2.0, 1.5), ("d", "s", "exercise", 2.4, 1.7), ("d", "t", "exercise", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "dataset_id string, subject_id string, condition string, eda__mean double, acc__mag__mean double")
    out = attach_baseline(df, baseline_profiles(df)).orderBy("subject_id", "eda__mean").collect()
    assert [r["eda__mean"] for r in out] == [1.0, 1.2, 2.0, 2.4, 1.0]
    assert out[2]["eda__mean__delta_from_profile_median"] == pytest.approx(0.9)
    assert out[2]["eda__mean__robust_z_from_profile"] == pytest.approx(0.9 / (1.4826 * 0.1))
    assert out[0]["baseline_profile_quality_0_1"] == pytest.approx(0.2) and out[4]["baseline_profile_available"] is False
    assert out[4]["baseline_profile_id"] is None and out[4]["baseline_state_label"] == "unknown_untrusted"


def test_ternary_score_invariants(spark):
    calm = (0.3, 0.0, 70.0, 5.0, 60.0, 70.0)
    aroused = (4.0, 0.05, 110.0, 5.0, 10.0, 12.0)
    df = spark.createDataFrame([calm, aroused, (None,) * 6], "eda__mean double, eda__slope_per_s double, hr__mean double, hr__std double, ibi__rmssd_ms double, ibi__sdnn_ms double")
    a, b, empty = K.ternary_score(df).collect()
    for r in (a, b, empty):
        assert r["sympathetic"] + r["parasympathetic"] + r["homeostasis"] == pytest.approx(1.0)
    assert b["sympathetic"] > a["sympathetic"] and a["recovery_0_1"] > b["recovery_0_1"]
    assert set(empty["notes"]) == {"sympathetic_missing_core", "parasympathetic_missing_core", "low_sensor_support", "pns_hrv_missing", "sns_eda_missing"}
    assert empty["sensor_quality_0_1"] == pytest.approx(0.15)


def test_preferences_and_confidence(spark):
    m = F.create_map(*[F.lit(x) for kv in (("pain", 0.9), ("stress", 0.85), ("activity", 0.8), ("low", 0.2)) for x in kv])
    got = spark.range(1).select(K.state_preferences(m, 1.0).alias("p")).first()["p"]
    assert sum(got.values()) == pytest.approx(1.0) and got["low"] < got["pain"] < 0.4
    with pytest.raises(ValueError):
        K.state_preferences(m, 0.0)
    df = spark.createDataFrame([(1, 1, 0, 0)], "bvp__present int, hr__present int, acc__present int, temperature__present int")
    used, missing = K.sensor_usage(df, ("bvp", "hr", "acc", "temperature"))
    r = df.select(used.alias("u"), missing.alias("m"), K.score_quality(used, missing).alias("q"), K.confidence(F.lit(0.9), F.lit(1.0)).alias("c")).first()
    assert r["u"] == ["bvp", "hr"] and r["m"] == ["acc", "temperature"] and r["q"] == pytest.approx(0.86) and r["c"] == pytest.approx(0.9)


def test_feature_sets_keep_out_leaks(spark):
    df = spark.createDataFrame([("d", "s", "x", 1.0, 1.0, 1.0, 1.0, 2.0, 0.5, None)], """dataset_id string, subject_id string, session_id string, window_start_s double,
        target_pain_nrs_0_10 double, bvp__mean double, hr__mean double, eda__mean double, baseline_distance_l1 double, acc__mag__mean double""")
    assert feature_columns(df, "apple_watch_like") == ["bvp__mean", "hr__mean", "baseline_distance_l1"]
    with pytest.raises(KeyError):
        feature_columns(df, "nope")
    assert math.isclose(df.select(K.autonomic_mode(F.lit(1.0), F.lit(-1.0)) == "reciprocal_sympathetic").first()[0], True)
